"""Reports as text files: one file per report under its name, in a folder per account.

A Python data source writes them.  Rows of a report come one after the other and are written as they come, so a report
of any length is never one value.  A task writes drafts and, once all of them are whole, moves them to their names; a
repeated attempt makes the same files again.  The job's commit removes what lost attempts left and adds ``_SUCCESS``;
its abort leaves an empty folder, also where tasks are still running: they see that the job is no longer open.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import RecordBatch, fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..columns import By, by_columns, quoted
from ..operators.joins import fresh_key

DRAFTS, DONE, OPEN = "_drafts", "_SUCCESS", "open"
ROW = "folder string, name string, text string"
READ_FILES = 2_000  # that one task reads, where there are many
BATCH_ROWS, BATCH_BYTES = 1_000, 16_000_000


@dataclass
class Written(WriterCommitMessage):
    files: int


class ReportWriter(DataSourceArrowWriter):
    """Writes rows (folder, name, text) that come report by report."""

    def __init__(self, path: str):
        self.path = path
        files, root = fs.FileSystem.from_uri(path)
        if any(x.base_name != DRAFTS for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True))):
            raise FileExistsError(f"{path} has files; reports are written to a new folder")
        files.create_dir(f"{root}/{DRAFTS}")
        with files.open_output_stream(f"{root}/{DRAFTS}/{OPEN}"):
            pass

    def write(self, iterator: Iterator[RecordBatch]) -> WriterCommitMessage:
        files, root = fs.FileSystem.from_uri(self.path)
        drafts = f"{root}/{DRAFTS}/{uuid.uuid4().hex}"
        reports: list[str] = []
        out = None

        def still_open() -> bool:
            return files.get_file_info(f"{root}/{DRAFTS}/{OPEN}").type == fs.FileType.File

        def stopped() -> RuntimeError:
            return RuntimeError(f"the job that writes {self.path} has ended")

        try:
            for batch in iterator:
                for folder, name, text in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "text"))):
                    target = f"{root}/{folder}/{name}" if folder else f"{root}/{name}"
                    if not reports or target != reports[-1]:
                        if out is not None:
                            out.close()
                        if not reports:
                            if not still_open():
                                raise stopped()
                            files.create_dir(drafts)
                        out = files.open_output_stream(f"{drafts}/{len(reports)}")
                        reports.append(target)
                    out.write((text or "").encode("utf-8", "surrogatepass"))
            if out is not None:
                out.close()
            for folder in {target.rpartition("/")[0] for target in reports}:
                files.create_dir(folder)
            for i, target in enumerate(reports):
                files.move(f"{drafts}/{i}", target)
            if reports and not still_open():
                for target in reports:
                    files.delete_file(target)
                raise stopped()
        finally:
            if reports and files.get_file_info(drafts).type == fs.FileType.Directory:
                files.delete_dir(drafts)
        return Written(len(reports))

    def commit(self, messages: list) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{root}/{DRAFTS}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{DRAFTS}")
        files.create_dir(root)
        with files.open_output_stream(f"{root}/{DONE}") as done:
            done.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.delete_dir_contents(root, missing_dir_ok=True)


class TextReports(DataSource):
    """``df.write.format("text_reports").mode("append").save(path)``, for rows (folder, name, text) in order of report."""

    @classmethod
    def name(cls) -> str:
        return "text_reports"

    def schema(self) -> str:
        return ROW

    def writer(self, schema: StructType, overwrite: bool) -> ReportWriter:
        if overwrite:
            raise ValueError("reports are written to a new folder; remove the old one yourself")
        if schema.names != ["folder", "name", "text"]:
            raise ValueError(f"rows have to be ({ROW}), not {schema.simpleString()}")
        return ReportWriter(self.options["path"])


def _folder(by: By):
    """``account_id=7``, one level for each account column; other marks than letters, digits and ``.-*_`` are escaped."""
    levels = [F.concat(F.lit(f"{c}="), F.coalesce(F.url_encode(quoted(c).cast("string")), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in by]
    return F.concat_ws("/", *levels) if levels else F.lit("")


def own_names(reports: DataFrame, by: By = (), key: str = "seq") -> DataFrame:
    """``by, key, name``: file names, made unique within an account: the report of least key has its own, the others ``~<key>`` in it.

    Counted by minima, which combine before the shuffle, and a join that AQE can split: half of all reports may have one name.
    """
    named = reports.select(*by_columns(by), key, "file_name").distinct()
    accounts = [quoted(c).alias(f"_by{i}") for i, c in enumerate(by)]
    first = named.groupBy(*by_columns(by), "file_name").agg(F.min(key).alias("_first")).select(
        *accounts, fresh_key("file_name").alias("_name"), "_first")
    same = F.col("file_name") == F.col("_name")
    for i, c in enumerate(by):
        same &= quoted(c).eqNullSafe(F.col(f"_by{i}"))
    apart = F.regexp_replace("file_name", r"(\.[^.]*)?$", "")
    end = F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    name = F.when(F.col(key) == F.col("_first"), F.col("file_name")).otherwise(F.concat(apart, F.lit("~"), F.col(key).cast("string"), end))
    return named.join(first, same).select(*by_columns(by), key, name.alias("name"))


def write_text_reports(rows: DataFrame, path: str, by: By = (), key: str = "seq", order: list[str] | None = None) -> None:
    """Report rows (``by, key, file_name, text`` and the columns ``order``) as one text file per report.

    The texts of a report, in that order, are the file. A report is in one task, as a file has one writer; all others are spread by
    account and key.  Null texts are empty; no rows give a folder with ``_SUCCESS`` only.
    """
    names = own_names(rows, by, key)
    accounts = [quoted(c).alias(f"_by{i}") for i, c in enumerate(by)]
    names = names.select(*accounts, F.col(key).alias("_key"), "name")
    same = F.col(key) == F.col("_key")
    for i, c in enumerate(by):
        same &= quoted(c).eqNullSafe(F.col(f"_by{i}"))
    one = [*by_columns(by), quoted(key)]
    placed = rows.join(names, same).repartition(*one).sortWithinPartitions(*one, *(quoted(c) for c in order or []))
    rows.sparkSession.dataSource.register(TextReports)
    placed.select(_folder(by).alias("folder"), "name", "text").write.format("text_reports").mode("append").save(path)


def write_email_reports(rows: DataFrame, path: str, by: By = (), key: str = "seq") -> None:
    """Rows of ``email_report`` as text files; each row ends its line."""
    lines = rows.withColumn("text", F.concat("text", F.lit("\n")))
    write_text_reports(lines, path, by, key, ["section", "turn"])


def _listed(files: fs.FileSystem, root: str, folder: str) -> Iterator[tuple[str, bool]]:
    """What a folder under ``root`` holds, and whether it is a folder; local ones are never held whole."""
    if isinstance(files, fs.LocalFileSystem):
        with os.scandir(f"{root}/{folder}") as entries:
            found = ((x.name, x.is_dir()) for x in entries)
            yield from ((f"{folder}/{name}" if folder else name, inner) for name, inner in found if not _hidden(name, inner))
        return
    for x in files.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root)):
        inner = x.type == fs.FileType.Directory
        if not _hidden(x.base_name, inner):
            yield f"{folder}/{x.base_name}" if folder else x.base_name, inner


def _hidden(name: str, folder: bool) -> bool:
    return name.startswith(".") or name.startswith("_") and not (folder and "=" in name)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size=lambda row: 0) -> Iterator[RecordBatch]:
    """Rows as batches of no more than ``BATCH_ROWS`` and, but for one row by itself, ``BATCH_BYTES``."""
    held, weight = [], 0
    for row in rows:
        if held and (len(held) == BATCH_ROWS or weight + size(row) > BATCH_BYTES):
            yield RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
        held.append(row)
        weight += size(row)
    if held:
        yield RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def read_text_reports(spark: SparkSession, path: str, by: By = ()) -> DataFrame:
    """``by (as text), name, text`` of the files that ``write_text_reports`` made; a folder without ``_SUCCESS`` is refused.

    Spark's own readers list files on the driver and open few of them in a task.  Here tasks list folders (``path`` itself is one task's),
    and the files, whose number ``_SUCCESS`` holds, are dealt to tasks by their names.
    """
    files, root = fs.FileSystem.from_uri(path)
    if files.get_file_info(f"{root}/{DONE}").type != fs.FileType.File:
        raise FileNotFoundError(f"{path} has no {DONE}")
    with files.open_input_stream(f"{root}/{DONE}") as done:
        number = int(done.read() or 0)
    names = pa.schema([("file", pa.string()), ("inner", pa.bool_())])
    texts = pa.schema([("file", pa.string()), ("text", pa.binary())])

    def top(_: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        yield from _batches(_listed(files, root, ""), names)

    def below(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)

        def walk(name: str, inner: bool) -> Iterator[tuple[str, bool]]:
            if not inner:
                yield name, False
                return
            for found in _listed(files, root, name):
                yield from walk(*found)

        for batch in batches:
            yield from _batches((found for name, inner in zip(*(c.to_pylist() for c in batch.columns)) for found in walk(name, inner)), names)

    def read(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)

        def text(name: str) -> bytes:
            with files.open_input_file(f"{root}/{name}") as file:
                return file.read()

        for batch in batches:
            yield from _batches(((name, text(name)) for name in batch.column("file").to_pylist()), texts, lambda row: len(row[1]))

    tasks = max(spark.sparkContext.defaultParallelism, -(-number // READ_FILES))
    listed = spark.range(0, 1, 1, 1).mapInArrow(top, "file string, inner boolean")
    if by:
        listed = listed.repartition(tasks, "file")
    listed = listed.mapInArrow(below, "file string, inner boolean").select("file")
    found = listed.repartition(tasks, "file").mapInArrow(read, "file string, text binary")
    parts = F.split(F.col("file"), "/")
    part = lambda i: F.element_at(parts, F.lit(-i))
    values = []
    for i, c in enumerate(by):
        value = F.substring_index(part(len(by) - i + 1), "=", -1)
        values.append(F.when(value != "__HIVE_DEFAULT_PARTITION__", F.url_decode(value)).alias(c))
    # The bytes as they are.
    return found.select(*values, part(1).alias("name"), F.col("text").cast("string").alias("text"))
