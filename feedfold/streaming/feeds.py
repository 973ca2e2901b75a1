"""Continuous refresh: sources, late rows, de-duplication, threads, counts, summaries.

Polling once a minute becomes a file stream with a one-minute trigger; each row is
read once instead of on every poll.  State is bounded by watermarks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..columns import By, Instant, by_columns, instant
from ..functions.fields import thread_key, thread_title
from ..operators.generation import Loader
from ..plans.summarize import summarize_emails
from ..sources.store import SummaryStore

REFRESH = "60 seconds"
WINDOW = "48 hours"
STEP = "1 hour"


def refresh_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New rows of a landing folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def every_minute(writer: DataStreamWriter, available_now: bool = False) -> DataStreamWriter:
    """Refresh trigger; ``available_now`` works off what is there and stops."""
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=REFRESH)


def drop_late(stream: DataFrame, ts: str = "ts", window: str = WINDOW, as_of: Instant | None = None,
              due: str = "due_ts") -> DataFrame:
    """Rows that are not older than ``window`` now, with a watermark on ``due``, the earlier of their time and now.

    Rows of the future stay: a reader sees them once they are due (``due_rows``).  They
    do not move the watermark ahead, so they make no other row late; a gap in the feed keeps none
    either, because rows are held against now and not against the newest row.
    """
    now = F.current_timestamp() if as_of is None else instant(as_of)
    fresh = stream.where(F.col(ts) > now - F.expr(f"interval {window}"))
    return fresh.withColumn(due, F.least(ts, now)).withWatermark(due, window)


def due_rows(rows: DataFrame, as_of: Instant, ts: str = "ts", window: str = WINDOW) -> DataFrame:
    """What of the rows read so far is in the window at ``as_of``, rows included that were of the future when they came."""
    now = instant(as_of)
    return rows.where((F.col(ts) <= now) & (F.col(ts) > now - F.expr(f"interval {window}")))


def stream_dedup(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str | None = WINDOW) -> DataFrame:
    """Each key once, also when it is delivered again; keys are forgotten after ``delay``."""
    if delay:
        stream = stream.withWatermark(ts, delay)
    return stream.dropDuplicatesWithinWatermark(keys)


def stream_thread_hours(messages: DataFrame, ts: str = "ts", delay: str = "1 hour", step: str = STEP,
                        by: By = ()) -> DataFrame:
    """Thread roll-up hour by hour, for output mode ``update``: an hour's threads leave the state ``delay`` after its end."""
    return (
        messages.withWatermark(ts, delay)
        .groupBy(F.window(ts, step).alias("_step"), *by_columns(by), thread_key().alias("thread_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max(F.struct("timestamp", "seq", "text")).alias("_last"),
            F.min(F.struct(F.col("seq"), thread_title().alias("title"))).alias("_first"),
        )
    )


def stream_threads(messages: DataFrame, ts: str = "ts", delay: str = "1 hour", step: str = STEP, by: By = ()) -> DataFrame:
    """Running thread roll-up for ``write_latest`` in mode ``update``; ``threads_of_hours`` puts the hours together.

    State and output are those of hours that still change, however old a thread is.
    """
    return stream_thread_hours(messages, ts, delay, step, by).select(
        F.col("_step.start").alias("hour"), *by_columns(by), "thread_id", "n", "_last", "_first")


def threads_of_hours(hours: DataFrame, as_of: Instant | None = None, window: str = WINDOW, by: By = ()) -> DataFrame:
    """Threads of the whole hours of the ``window`` before ``as_of`` (without: of all time) from ``stream_threads`` output kept by batch.

    ``as_of`` has to be the end of a whole hour, as messages are no longer told apart: other moments raise an
    error.  ``live.threads_at`` answers for any second.
    """
    rows = latest_updates(hours, ["hour", *by, "thread_id"])
    if as_of is not None:
        now = instant(as_of)
        whole = F.when(F.date_trunc("hour", now) == now, now).otherwise(F.raise_error(F.lit("as_of is not a whole hour")).cast("timestamp"))
        rows = rows.where((F.col("hour") < whole) & (F.col("hour") >= whole - F.expr(f"interval {window}")))
    return rows.groupBy(*by_columns(by), "thread_id").agg(
        F.sum("n").alias("message_count"), F.max("_last").alias("_last"), F.min("_first").alias("_first")
    ).select(
        *by_columns(by), "thread_id", F.col("_first.title").alias("title"), "message_count",
        F.col("_last.text").alias("last_message"), F.col("_last.timestamp").alias("last_ts"),
        F.col("_first.seq").alias("first_seq"))


def stream_rolling_counts(stream: DataFrame, key: Column, ts: str = "ts", delay: str = "1 hour",
                          window: str = WINDOW, step: str = STEP, by: By = ()) -> DataFrame:
    """Rows per thread in the last 48 hours, hour by hour, in ``append`` mode.

    Rows are first counted per hour; the sliding windows then add up hours.  A row
    would otherwise be copied into all 48 windows it lies in before any counting.
    The window must be a whole number of steps.
    """
    hourly = (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, step).alias("_step"), *by_columns(by), key.alias("thread_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.window_time("_step").alias("_time"), *by_columns(by), "thread_id", "n")
    )
    return (
        hourly.groupBy(F.window("_time", window, step).alias("_window"), *by_columns(by), "thread_id")
        .agg(F.sum("n").alias("message_count"))
        .select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"),
                *by_columns(by), "thread_id", "message_count")
    )


def stream_rolling_threads(messages: DataFrame, ts: str = "ts", delay: str = "1 hour",
                           window: str = WINDOW, step: str = STEP, by: By = ()) -> DataFrame:
    """Thread roll-up over the last 48 hours, step by step, in ``append`` mode: rows
    leave as the window moves on.

    Steps are rolled up first; count, latest and first message of the window follow
    from those of its steps.  The window must be a whole number of steps.
    """
    hourly = stream_thread_hours(messages, ts, delay, step, by).select(
        F.window_time("_step").alias("_time"), *by_columns(by), "thread_id", "n", "_last", "_first")
    return (
        hourly.groupBy(F.window("_time", window, step).alias("_window"), *by_columns(by), "thread_id")
        .agg(F.sum("n").alias("message_count"), F.max("_last").alias("_last"), F.min("_first").alias("_first"))
        .select(
            F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"),
            *by_columns(by), "thread_id", F.col("_first.title").alias("title"), "message_count",
            F.col("_last.text").alias("last_message"), F.col("_last.timestamp").alias("last_ts"),
            F.col("_first.seq").alias("first_seq"),
        )
    )


def append_to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return every_minute(writer, available_now).start()


def write_latest(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                 available_now: bool = False) -> StreamingQuery:
    """Each batch's result under ``batch=<id>``; a repeated batch replaces its own folder."""
    def save(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return every_minute(writer.foreachBatch(save), available_now).start()


def latest_updates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The current row per key from ``update`` mode output kept by batch."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*others), F.col("batch")).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query, from its checkpoint: a new one where the folder was made anew."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"].replace("-", "")


def fold_batches(spark: SparkSession, path: str, keys: list[str], keep: int = 1) -> int:
    """Put all batches but the newest ``keep`` of ``update`` output into one, and remove their folders; how many went.

    The current rows of the old batches are added to the newest of them, file by file, and only then the others go:
    at any moment a reader finds each key's current row (once more, perhaps, which
    ``latest_updates`` does not mind), also if this stops half way.
    """
    numbers = sorted(r.batch for r in spark.read.parquet(path).select("batch").distinct().collect())
    old = numbers[: len(numbers) - keep]
    if len(old) < 2:
        return 0
    draft = f"{path}/_fold-{uuid.uuid4().hex}"  # not seen by readers
    latest_updates(spark.read.parquet(path).where(F.col("batch") <= old[-1]), keys).write.parquet(draft)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(at(draft)):
        name = status.getPath().getName()
        if name.startswith("part-") and not fs.rename(status.getPath(), at(f"{path}/batch={old[-1]}/{name}")):
            raise OSError(f"{name} of {draft} could not be moved")
    fs.delete(at(draft), True)
    for number in old[:-1]:
        fs.delete(at(f"{path}/batch={number}"), True)
    return len(old) - 1


def stream_summarize(requests: DataFrame, store: SummaryStore, models: Mapping[str, Loader],
                     as_of: Callable[[], Instant], checkpoint: str, results: str | None = None,
                     available_now: bool = False) -> StreamingQuery:
    """Summarise new mails batch by batch.

    A batch that is repeated after a failure finds its results in the store's ledger: nothing is generated or stored
    twice, and the rows are those of the first time.
    """
    def serve(rows: DataFrame, batch_id: int) -> None:
        tag = f"{_query_id(rows.sparkSession, checkpoint)}b{batch_id}"
        out = summarize_emails(rows, store, models, as_of(), tag=tag)
        if results:
            out.write.mode("overwrite").parquet(f"{results}/batch={batch_id}")

    writer = requests.writeStream.option("checkpointLocation", checkpoint)
    return every_minute(writer.foreachBatch(serve), available_now).start()
