"""Reports as files: names, accounts, lost tasks."""

import os
import time

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from feedfold.sources import text_files

ROWS = "account string, seq bigint, file_name string, part int, text string"


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_accounts_and_equal_names(spark, rows, tmp_path):
    odd = ["a/b", "..", "x y+z", "50%", "é世", "", None, "__HIVE", "a=b"]
    data = [(account, i, "same.txt" if i % 3 else "no_end", part, f"{account} {i} {part}\r\n" if part else None)
            for account in odd for i in range(7) for part in (2, 0, 1)]
    path = str(tmp_path / "out")
    text_files.write_text_reports(rows(ROWS, *data), path, ["account"], "seq", ["part"])
    got = {(r.account, r.name): r.text for r in text_files.read_text_reports(spark, path, ["account"]).collect()}
    want = {(a, name): f"{a} {i} 1\r\n{a} {i} 2\r\n" for a in odd
            for i, name in enumerate(["no_end", "same.txt", "same~2.txt", "no_end~3", "same~4.txt", "same~5.txt", "no_end~6"])}
    assert got == want
    assert open(f"{path}/_SUCCESS").read() == str(len(want)) and "_drafts" not in os.listdir(path)


def test_no_account_empty_and_repeated_folder(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    text_files.write_text_reports(rows(ROWS, ("a", 1, "r.txt", 0, "x"), ("a", 1, "r.txt", 1, "y")), path, (), "seq", ["part"])
    assert files(path) == ["_SUCCESS", "r.txt"] and open(f"{path}/r.txt").read() == "xy"
    with pytest.raises(PySparkException, match="new folder"):
        text_files.write_text_reports(rows(ROWS, ("a", 1, "r.txt", 0, "z")), path)
    assert open(f"{path}/r.txt").read() == "xy"
    none = str(tmp_path / "none")
    text_files.write_text_reports(rows(ROWS, ("a", 1, "r.txt", 0, "x")).where("false"), none)
    assert files(none) == ["_SUCCESS"] and text_files.read_text_reports(spark, none).count() == 0


def test_a_long_report_is_written_as_it_comes(spark, tmp_path):
    long = spark.range(300_000).select(F.lit(5).cast("bigint").alias("seq"), F.lit("long.txt").alias("file_name"), F.col("id").alias("turn"),
                                       F.concat(F.col("id").cast("string"), F.lit("\n")).alias("text"))
    path = str(tmp_path / "out")
    text_files.write_text_reports(long, path, (), "seq", ["turn"])
    assert open(f"{path}/long.txt").read() == "".join(f"{i}\n" for i in range(300_000))


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    """The worker of one task dies after other reports were written: the job fails, and no report is left."""
    def die(batches):
        for batch in batches:
            yield batch
            if 77 in batch.column("seq").to_pylist():
                os._exit(1)

    data = spark.range(200).select(F.col("id").alias("seq"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("file_name"),
                                   F.lit("text").alias("text"))
    path = str(tmp_path / "out")
    text_files.write_text_reports(data, path)
    assert len(files(path)) == 201
    # What the sink is given comes from the dying worker's stage.
    path = str(tmp_path / "lost")
    spark.dataSource.register(text_files.TextReports)
    rows = data.repartition(4, "seq").select(F.lit("").alias("folder"), F.col("file_name").alias("name"), "text", "seq").mapInArrow(
        die, "folder string, name string, text string, seq bigint").select("folder", "name", "text")
    with pytest.raises(Exception):
        rows.write.format("text_reports").mode("append").save(path)
    for _ in range(100):  # other tasks may still be about to end
        if not files(path):
            break
        time.sleep(0.1)
    assert files(path) == []
    with pytest.raises(FileNotFoundError):
        text_files.read_text_reports(spark, path)


def test_attempts_that_are_lost_or_repeated(tmp_path):
    """What the commit does not know of goes; a repeated attempt makes the same files."""
    path = str(tmp_path / "out")
    writer = text_files.ReportWriter(path)
    batch = lambda *r: pa.RecordBatch.from_pylist([dict(zip(("folder", "name", "text"), x)) for x in r])

    def breaks():
        yield batch(("a", "1.txt", "one"), ("a", "2.txt", "tw"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(breaks())
    assert files(path) == ["_drafts/open"]
    os.makedirs(f"{path}/_drafts/lost")
    open(f"{path}/_drafts/lost/0", "w").write("half")
    whole = [batch(("a", "1.txt", "one"), ("a", "2.txt", "tw")), batch(("a", "2.txt", "o"), ("", "3.txt", "世"))]
    messages = [writer.write(iter(whole)) for _ in range(2)]
    writer.commit(messages[1:] + [None])
    assert files(path) == ["3.txt", "_SUCCESS", "a/1.txt", "a/2.txt"]
    assert open(f"{path}/a/2.txt").read() == "two" and open(f"{path}/_SUCCESS").read() == "3"
    writer.abort([])
    assert files(path) == []
    with pytest.raises(RuntimeError, match="has ended"):  # a task that is still running then
        writer.write(iter(whole))
    assert files(path) == []


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    """Spark's text reader packs 32 small files into a task, and lists all on the driver."""
    path = str(tmp_path / "out")
    rows = spark.range(1_000).selectExpr("concat('k', id % 2) as account", "id as seq", "concat('r', id, '.txt') as file_name", "if(id % 7 = 0, '', repeat(id, 3)) as text")
    text_files.write_text_reports(rows, path, ["account"])
    read = text_files.read_text_reports(spark, path, ["account"])
    assert read.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    want = {(f"k{i % 2}", f"r{i}.txt"): "" if i % 7 == 0 else str(i) * 3 for i in range(1_000)}
    assert {(r.account, r.name): r.text for r in read.collect()} == want


def test_batches_of_files():
    schema = pa.schema([("file", pa.string()), ("text", pa.binary())])
    data = [("a", b"x" * 15_999_999), ("b", b"y"), ("c", b"z"), ("d", b"x" * 20_000_000), *[("e", b"")] * 1_500]
    got = [b.num_rows for b in text_files._batches(iter(data), schema, lambda row: len(row[1]))]
    assert got == [2, 1, 1, 1_000, 500]
