"""Readers for the export files of the four feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F

from .. import fixed
from ..entities import (
    CALENDAR_EXPORT_FIELDS,
    EMAIL_EXPORT_FIELDS,
    MESSAGE_EXPORT_FIELDS,
    REMINDER_EXPORT_FIELDS,
)
from ..columns import as_column, let, quoted
from ..functions.fields import first_truthy, parse_epoch, to_int_or_zero
from ..session import scratch_path


BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _mail_field(name: str, record: Column) -> Column:
    """The field's text, or NULL where its pattern does not occur in the record."""
    pattern = fixed.MAIL_BODY if name == "body" else fixed.MAIL_FIELD.format(name=name)
    return F.get(F.regexp_extract_all(record, F.lit(pattern), F.lit(1)), F.lit(0))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The text of files up to each ``}``; files of any size are split there and read by many tasks."""
    return (
        spark.read.option("lineSep", "}").text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("_size"),
            F.col("_metadata.file_block_start").alias("_part"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )


def _landed(df: DataFrame, purpose: str) -> DataFrame:
    """The rows from a scratch table, so that what made them is done once."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _earlier(amount: str, window: WindowSpec) -> Column:
    """The sum of the rows before."""
    return F.coalesce(F.sum(amount).over(window.rowsBetween(*BEFORE)), F.lit(0).cast("bigint"))


def _first_numbers(parts: DataFrame) -> DataFrame:
    """Where the numbers of a file's places begin: files by name, a row for each, after the places of those before.

    Files are put in ranges of names by Spark and landed, so that ranges stay as they are; they are summed up inside
    ranges, and of each range (no more than shuffle partitions) the driver gets one number.
    """
    files = parts.groupBy(F.col("file").alias("_file")).agg(F.sum("_places").alias("_in_file"))
    files = _landed(files.repartitionByRange("_file").withColumn("_range", F.spark_partition_id()), "export-files")
    before, starts = 0, []
    for r in files.groupBy("_range").agg(F.sum("_in_file").alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], before))
        before += r.n
    starts = files.sparkSession.createDataFrame(starts, "_of int, _first_of bigint")
    inside = _earlier("_in_file", Window.partitionBy("_range").orderBy("_file"))
    files = files.withColumn("_number", inside).join(starts, F.col("_range") == F.col("_of"))
    return files.select("_file", "_in_file", (F.col("_number") + F.col("_first_of")).alias("_number"))


def read_mail_export(spark: SparkSession, path: str, check_tail: bool = True) -> DataFrame:
    """Mail records from text that only looks like JSON (bodies are not escaped).

    A record runs from a ``{`` to the next ``}``, so the reader lets the text
    source split files *at* ``}``: each row is one candidate record, files of any
    size are read by many tasks, and no file is ever held as one value.

    ``seq`` orders files by name and records by place, and counts on from file to file.  One extra pass that only counts rows and bytes
    of each part of a file tells where a part's places begin, and, with ``check_tail``, whether a file ends in the middle
    of a record: that remainder, its last row, is dropped.
    """
    rows = _chunks(spark, path)
    # Each row but an unfinished last one has its closing brace in the file.
    parts = rows.groupBy("file", "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_places"),
        F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_all"))
    whole = Window.partitionBy("file")
    total = F.sum("_places").over(whole)
    numbers = _first_numbers(parts)
    parts = parts.select(
        F.col("file").alias("_file"), F.col("_part").alias("_start"), "_first", _earlier("_places", whole.orderBy("_part")).alias("_before"),
        F.when(F.sum("_bytes").over(whole) > F.max("_all").over(whole), total - 1).alias("_unfinished"))
    parts = parts.join(numbers, "_file")
    placed = rows.join(parts, (F.col("file") == F.col("_file")) & (F.col("_part") == F.col("_start")))
    place = F.col("_before") + F.col("_row") - F.col("_first")
    records = placed.withColumn("_place", place)
    if check_tail:
        records = records.where(F.col("_unfinished").isNull() | (F.col("_place") < F.col("_unfinished")))
    start = F.instr("value", "{")
    records = records.where((start > 0) & (start < F.length("value")))
    record = F.concat(F.expr("substr(value, instr(value, '{'))"), F.lit("}"))
    seq = (F.col("_number") + F.col("_place")).alias("seq")
    fields = records.select("file", seq, *[_mail_field(name, record).alias(name) for name in EMAIL_EXPORT_FIELDS])
    found = F.coalesce(*[quoted(name) for name in EMAIL_EXPORT_FIELDS])
    return fields.where(found.isNotNull())


def _nesting(text: Column) -> Column:
    """By how much a text without strings goes deeper."""
    opened, closed = (F.length(F.translate(text, marks, "")) for marks in ("[{", "]}"))
    return closed - opened


def _array_segments(spark: SparkSession, path: str) -> DataFrame:
    """Arrays cut into texts of one object each (and the ``null`` before it), with no file held as a value.

    Whether a ``}`` ends an element of the array depends on all text before it: on whether a string is open and on the
    depth.  Both are prefix sums.  A chunk's own share is worked out for either case, of beginning outside or inside of a
    string; the shares are added up within each part of a file that a task reads, then over the parts (a row each), and what
    came out is given back to the chunks.  Only elements that more than one chunk holds are put together by a shuffle.

    ``_text`` is what stands between the segment's neighbours, NULL where the mark that has to be there (bracket or comma)
    is missing.  If every segment of a file is the inside of a valid array, the file is one, and else it is none:
    the segments are all of its text, so nothing has to be believed of the sums where a file is broken.
    """
    # Only quotes and brackets; an escape never goes over a "}".
    marks = F.regexp_replace("value", r'(?s)\\.|[^"{}\[\]\\]++', "")
    rows = _chunks(spark, path).withColumn("_marks", marks)
    strings, first_string = r'"[^"]*"?', r'^[^"]*"?'
    flips = (F.length("_marks") - F.length(F.translate("_marks", '"', ""))) % 2
    outside = _nesting(F.regexp_replace("_marks", strings, "")) - F.when(flips == 0, 1).otherwise(0)
    inside = _nesting(F.regexp_replace(F.regexp_replace("_marks", first_string, ""), strings, "")) - flips
    # An element, and one for each null that can stand before its brace.
    places = 1 + F.regexp_count(F.substring_index("value", "{", 1), F.lit("null"))
    part = Window.partitionBy("file", "_part").orderBy("_row")
    rows = rows.select(
        "file", "_part", "_row", "_size", "value", (F.octet_length("value") + 1).alias("_bytes"), flips.cast("bigint").alias("_flips"), outside.alias("_outside"),
        inside.alias("_inside"), places.cast("bigint").alias("_places"))
    rows = rows.withColumns({"_odd": _earlier("_flips", part) % 2, "_place": _earlier("_places", part)})
    rows = rows.withColumns({  # for parts that begin outside (0) and inside (1) of a string
        f"_deeper{case}": F.when(F.col("_odd") == case, F.col("_outside")).otherwise(F.col("_inside")) for case in (0, 1)})
    rows = rows.withColumns({f"_depth{case}": F.sum(f"_deeper{case}").over(part.rowsBetween(*SO_FAR)) for case in (0, 1)})
    ends_outside = [(F.col("_odd") + F.col("_flips") + case) % 2 == 0 for case in (0, 1)]

    next_place = F.col("_place") + F.col("_places")
    sums = rows.groupBy("file", "_part").agg(
        (F.sum("_flips") % 2).alias("_flips"), F.sum("_places").alias("_places"),
        F.sum("_bytes").alias("_bytes"), F.max("_size").alias("_size"),
        *[F.sum(f"_deeper{case}").alias(f"_deeper{case}") for case in (0, 1)],
        *[F.min(F.when(ends_outside[case], F.struct(F.col(f"_depth{case}").alias("depth"), (-next_place).alias("place"))))
          .alias(f"_lowest{case}") for case in (0, 1)])
    sums = _landed(sums, "export-parts")  # a row for each part
    numbers = _first_numbers(sums)
    whole = Window.partitionBy("file")
    by_part = whole.orderBy("_part")
    parts = sums.withColumns({"_in_string": _earlier("_flips", by_part) % 2, "_before": _earlier("_places", by_part)})
    parts = parts.withColumns({name: F.when(F.col("_in_string") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
                               for name in ("_deeper", "_lowest")})
    parts = parts.withColumn("_depth", _earlier("_deeper", by_part))
    lowest = F.col("_depth") + F.col("_lowest.depth")
    opened = F.when(lowest == 1, F.col("_before") - F.col("_lowest.place"))  # where the element that goes on after the part begins
    parts = parts.withColumns({
        "_opened": opened, "_too_low": (lowest < 1) & F.lead("_part").over(by_part).isNotNull()})
    parts = parts.select(
        F.col("file").alias("_file"), F.col("_part").alias("_of"), "_in_string", "_before", F.col("_depth").alias("_base"),
        F.coalesce(F.last("_opened", ignorenulls=True).over(by_part.rowsBetween(*BEFORE)), F.lit(0).cast("bigint")).alias("_open"),
        # The last chunk has no brace of its own, and an array is not over before it.
        ((F.sum("_bytes").over(whole) == F.max("_size").over(whole) + 1)
         & ~F.coalesce(F.bool_or("_too_low").over(whole), F.lit(False))).alias("_sound"))
    parts = parts.join(numbers, "_file")

    rows = rows.join(parts, (F.col("file") == F.col("_file")) & (F.col("_part") == F.col("_of")))
    by_case = lambda zero, one: F.when(F.col("_in_string") == 0, zero).otherwise(one)
    rows = rows.withColumns({
        "_ends": by_case(*ends_outside) & (F.col("_base") + by_case(F.col("_depth0"), F.col("_depth1")) == 1),
        "_at": F.col("_before") + F.col("_place")})
    rows = rows.withColumn("_begins", (F.col("_at") == 0) | F.coalesce(
        F.lag("_ends").over(part), (F.col("_in_string") == 0) & (F.col("_base") == 1)))
    rows = rows.withColumns({
        "_start": F.coalesce(F.max(F.when(F.col("_begins"), F.col("_at"))).over(part.rowsBetween(*SO_FAR)), F.col("_open")),
        "_last": F.col("_at") + F.col("_places") == F.col("_in_file")})
    rows = rows.withColumn("value", F.concat("value", F.when(F.col("_last"), "").otherwise("}")))

    key = ["file", "_number", "_sound", "_start"]
    alone = F.col("_begins") & (F.col("_ends") | F.col("_last"))
    pieces = F.array_sort(F.collect_list(F.struct("_at", "value")))["value"]
    joined = rows.where(~alone).groupBy(*key).agg(F.array_join(pieces, "").alias("value"), F.bool_or("_last").alias("_last"))
    segments = rows.where(alone).select(*key, "value", "_last").unionByName(joined)

    # What has to stand before and after; the last one may hold nothing, and no comma then.
    white = F.lit(" \t\n\r")
    first, last = F.col("_start") == 0, F.col("_last")
    end = let(F.rtrim("value", white), lambda text: F.when(text.endswith("]"), F.left(text, F.length(text) - 1)))
    segments = segments.withColumn("_text", F.ltrim(F.when(last, end).otherwise(F.col("value")), white))
    opened = F.col("_text").startswith(F.when(first, "[").otherwise(","))
    nothing = last & ~first & (F.col("_text") == "")
    segments = segments.withColumns({
        "_text": F.when(nothing, "").when(opened, F.expr("substr(_text, 2)")), "_nothing": nothing})
    empty = F.col("_nothing") | (first & last & (F.ltrim("_text", white) == ""))
    return segments.select("file", (F.col("_number") + F.col("_start")).alias("_seq"), "_sound", "_text", empty.alias("_empty"))


def _read_array(spark: SparkSession, path: str, fields: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """Objects of files that each hold one JSON array; of ``numbers``, whether a value was a number is kept in ``_is_<name>``.

    A file that is not a valid array, to its last character, gives no rows at all; yet files of any size are read
    by many tasks, as what is parsed is a segment (``_array_segments``), and files with a bad one are left out.  To find what
    follows a segment, it is parsed twice: as the only element of an array and as the only field of an object.
    The files are read at once, in two passes, and the objects are landed in the shared folder.
    ``seq`` orders files by name and objects by place; it has gaps where objects hold others.  An object is one value (2 GB at most).
    """
    item = ", ".join(f"`{name}` {'variant' if name in numbers else 'string'}" for name in fields)
    strict = {"allowSingleQuotes": "false"}
    alone = F.from_json(F.concat(F.lit("[["), "_text", F.lit("]]")), f"array<array<struct<{item}>>>", strict)
    only = F.from_json(F.concat(F.lit('{"all":['), "_text", F.lit("]}")), "struct<all: array<variant>>", strict)
    read = _array_segments(spark, path).where(~F.coalesce(F.col("_empty") & F.col("_sound"), F.lit(False)))
    read = read.select("file", "_seq", "_sound", alone.alias("alone"), only["all"].alias("only"))
    objects = F.get("alone", F.lit(0))
    good = F.col("_sound") & (F.size("alone") == 1) & (F.size(objects) > 0) & F.col("only").isNotNull()
    read = read.select("file", "_seq", F.coalesce(good, F.lit(False)).alias("_good"), objects.alias("_objects"))
    read = read.select("file", "_seq", "_good", F.posexplode_outer("_objects").alias("_place", "item"))
    out = read.select("file", (F.col("_seq") + F.col("_place")).alias("seq"), "_good", "item.*")
    for name in numbers:
        value = quoted(name)
        out = out.withColumns({
            f"_is_{name}": F.coalesce(~F.schema_of_variant(value).isin("STRING", "VOID", "BOOLEAN"), F.lit(False)),
            name: F.try_variant_get(value, "$", "string")})
    out = _landed(out, "export-objects")
    bad = out.where(~F.col("_good")).select("file")
    if bad.isEmpty():  # told by the landed files' statistics; the join would move all objects
        return out.drop("_good")
    return out.where("_good").drop("_good").join(bad.distinct(), "file", "left_anti")


def _seconds(name: str, otherwise: Column) -> Column:
    """A number cut to whole seconds; text as ``otherwise`` reads it."""
    number = quoted(name).try_cast("decimal(38,9)").try_cast("bigint")
    return F.when(F.col(f"_is_{name}"), F.coalesce(number, F.lit(0).cast("bigint"))).otherwise(otherwise)


def _moment(text: Column | str) -> Column:
    return F.try_to_timestamp(as_column(text), F.lit("yyyy-MM-dd HH:mm:ss"))


def read_calendar_export(spark: SparkSession, path: str) -> DataFrame:
    events = _read_array(spark, path, CALENDAR_EXPORT_FIELDS, ("start_ts", "end_ts"))
    return events.withColumns(
        {name: _seconds(name, to_int_or_zero(name)) for name in ("start_ts", "end_ts")}
    ).drop("_is_start_ts", "_is_end_ts")


def read_reminder_export(spark: SparkSession, path: str) -> DataFrame:
    reminders = _read_array(spark, path, REMINDER_EXPORT_FIELDS, ("due_ts",))
    return reminders.withColumn("due_ts", _seconds("due_ts", parse_epoch(first_truthy("due_ts", "due")))).drop("_is_due_ts")


def read_message_export(spark: SparkSession, path: str) -> DataFrame:
    messages = _read_array(spark, path, MESSAGE_EXPORT_FIELDS, ("timestamp",))
    return messages.withColumn(
        "timestamp", _seconds("timestamp", parse_epoch(first_truthy("timestamp", "date")))).drop("_is_timestamp")


# From exports to the entities of the other operators: dates become timestamps, NULL where a text is none.

def exported_emails(export: DataFrame) -> DataFrame:
    return export.withColumn("date", _moment("date"))


def exported_calendar(export: DataFrame) -> DataFrame:
    """Events by their text or, where it is none, by their epoch seconds."""
    def moment(text: str, number: str) -> Column:
        return F.coalesce(_moment(quoted(text)), F.when(F.col(number) > 0, F.timestamp_seconds(number)))
    return export.withColumns({"start": moment("start", "start_ts"), "end": moment("end", "end_ts")})


def exported_reminders(export: DataFrame) -> DataFrame:
    """Reminders are exported while they are open; without a date, ``due_ts`` is NULL again."""
    number = F.when(F.col("due_ts") != 0, F.col("due_ts"))
    return export.withColumns({"due": F.timestamp_seconds(number), "due_ts": number, "completed": F.lit(False)})
