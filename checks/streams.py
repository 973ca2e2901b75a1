"""Streams over the events table, worked off to the end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold.operators.threads import thread_rollup
from feedfold.session import scratch_path
from feedfold.sources.store import SummaryStore
from feedfold.streaming import feeds as streams, live

from . import adapters as a
from .adapters import AS_OF, with_ctes
from .models import length_model
from .stored import _SUMMARIZED

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


PER_FILE = 20_000  # rows
MOST_FILES = 1_000  # of a part: the file source remembers 10,000 unread files, and batches stay whole parts below that


def _landed(spark, parts, schema, copies=1):
    """The parts as a stream of one batch each, ``copies`` times: every part is as many files, written and read by as many tasks."""
    landing = scratch_path(spark, "landing")
    counts = [part.count() for part in parts]
    # A part without rows would be one file, whatever the number; it changes nothing, so it is landed only if it is all there is.
    least = min((n for n in counts if n), default=0)
    files = max(1, min(MOST_FILES, -(-least // PER_FILE)))
    for part in [p for p, n in zip(parts, counts) if n] or parts[:1]:
        for _ in range(copies):
            part.repartition(files).write.mode("append").parquet(landing)
    return streams.refresh_stream(spark, landing, schema, files_per_trigger=files)


def _events(spark, sf, parts=3, copies=1):
    """The events table as a stream with a time Spark can put a watermark on: landed in ``parts``
    in order of time, each ``copies`` times, and read part by part."""
    events = a.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = F.dayofmonth("ts") - 1
    dealt = [events.where(F.least(F.floor(day * parts / 30), F.lit(parts - 1)) == part) for part in range(parts)]
    return _landed(spark, dealt, events.schema, copies)


def _through(stream, spark):
    """What the stream appends, as a table."""
    path, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    streams.append_to_table(stream, path, checkpoint, available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query("refresh_stream", "select event_id, user_id, event_type from events")
def _(spark, sf):
    return _through(_events(spark, sf).select("event_id", "user_id", "event_type"), spark)


@query("stream_dedup", "select event_id, user_id, event_type from events")
def _(spark, sf):
    # Every poll delivers the same rows again: each is landed twice.
    once = streams.stream_dedup(_events(spark, sf, copies=2), ["event_id"], delay="60 days")
    return _through(once, spark).select("event_id", "user_id", "event_type")


def _chats(stream):
    return stream.selectExpr(
        "event_id as seq", "ts", "unix_timestamp(ts) as timestamp",
        "case when event_type = 'error' then '' else event_type end as chat_id",
        "concat('user-', user_id) as chat_name", "'' as sender", "cast(value as string) as text")


_CHATS = """select event_id as seq, epoch_us(ts) // 1000000 as timestamp,
    coalesce(nullif(case when event_type = 'error' then '' else event_type end, ''), 'user-' || user_id) as thread_id,
    'user-' || user_id as title, value as text from events"""


@query("stream_threads", f"""
    select thread_id, arg_min(title, seq) as title, count(*) as message_count, arg_max(text, row(timestamp, seq)) as last_value,
      max(timestamp) as last_ts, min(seq) as first_seq from ({_CHATS}) group by thread_id""")
def _(spark, sf):
    running = streams.stream_threads(_chats(_events(spark, sf)))
    path, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    streams.write_latest(running, path, checkpoint, available_now=True).awaitTermination()
    latest = streams.threads_of_hours(spark.read.parquet(path))
    return latest.withColumn("last_value", F.col("last_message").cast("double")).drop("last_message")


@query("stream_threads_batch", f"""
    select thread_id, arg_min(title, seq) as title, count(*) as message_count, max(timestamp) as last_ts
    from ({_CHATS}) group by thread_id""")
def _(spark, sf):
    events = a.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rolled = thread_rollup(_chats(events).withColumn("date", F.lit("")))
    return rolled.select("thread_id", "title", "message_count", "last_ts")


# At three moments, with minutes and seconds: what the window holds to the second.
_MOMENTS = ("2024-01-05 13:37:11", "2024-01-12 12:30:00", "2024-01-25 23:59:59")


@query("stream_live_threads", f"""
    with m as ({_CHATS}), moments as (select unnest([{', '.join(f"timestamp '{m}'" for m in _MOMENTS)}]) as as_of)
    select epoch_us(as_of) // 1000000 as as_of, thread_id, arg_min(title, seq) as title, count(*) as message_count,
      arg_max(text, row(timestamp, seq)) as last_value, max(timestamp) as last_ts, min(seq) as first_seq
    from m, moments where timestamp > epoch_us(as_of) // 1000000 - 48 * 3600 and timestamp <= epoch_us(as_of) // 1000000 group by as_of, thread_id""")
def _(spark, sf):
    with live.state_store(spark):
        changes = _through(live.stream_live_threads(_chats(_events(spark, sf))), spark)
    out = None
    for moment in _MOMENTS:
        threads = live.threads_at(changes, moment).withColumn("last_value", F.col("last_message").cast("double")).drop("last_message")
        threads = threads.withColumn("as_of", F.unix_timestamp(F.lit(moment).cast("timestamp")))
        out = threads if out is None else out.unionByName(threads)
    return out


# Windows that ended an hour or more before the last event are complete.
_ROLLING = """
    with h as (select date_trunc('hour', ts) as h, event_type as thread_id, count(*) as n from events group by all),
      last as (select max(ts) - interval 1 hour as mark from events)
    select epoch_us(w) // 1000000 as window_start, thread_id, cast(sum(n) as bigint) as message_count
    from (select *, unnest(range(0, 48)) as i, h - to_hours(unnest(range(0, 48))) as w from h), last
    where w + interval 48 hour <= date_trunc('hour', mark) group by all"""


@query("stream_rolling_counts", _ROLLING)
def _(spark, sf):
    counts = streams.stream_rolling_counts(_events(spark, sf), F.col("event_type"))
    return _through(counts, spark).select(
        F.unix_timestamp("window_start").alias("window_start"), "thread_id", "message_count")


@query("stream_rolling_threads", f"""
    with m as ({_CHATS}), mark as (select (max(timestamp) - 3600) // 3600 * 3600 as mark from m),
      x as (select *, (timestamp // 3600 - unnest(range(0, 48))) * 3600 as window_start from m)
    select window_start, thread_id, arg_min(title, seq) as title, count(*) as message_count,
      arg_max(text, row(timestamp, seq)) as last_value, max(timestamp) as last_ts, min(seq) as first_seq
    from x, mark where window_start + 48 * 3600 <= mark group by window_start, thread_id""")
def _(spark, sf):
    rolled = streams.stream_rolling_threads(_chats(_events(spark, sf)))
    return _through(rolled, spark).select(
        F.unix_timestamp("window_start").alias("window_start"), "thread_id", "title", "message_count",
        F.col("last_message").cast("double").alias("last_value"), "last_ts", "first_seq")


# Read at noon of the 12th, when the rows of the first days are late and those of the last are of the future;
# looked at then, and once more ten days later, when some of the latter are due.
@query("late_and_future", """
    select event_id, event_type, 'then' as seen from events where ts > timestamp '2024-01-10 12:00:00' and ts <= timestamp '2024-01-12 12:00:00'
    union all select event_id, event_type, 'later' from events where ts > timestamp '2024-01-20 12:00:00' and ts <= timestamp '2024-01-22 12:00:00'""")
def _(spark, sf):
    kept = streams.drop_late(_events(spark, sf, copies=2), as_of="2024-01-12 12:00:00")
    landed = _through(streams.stream_dedup(kept, ["event_id"], delay=None), spark)
    views = [streams.due_rows(landed, f"2024-01-{day} 12:00:00").select("event_id", "event_type", F.lit(seen).alias("seen"))
             for day, seen in ((12, "then"), (22, "later"))]
    return views[0].unionByName(views[1])


@query("stream_summarize", with_ctes("f_requests f_summaries", _SUMMARIZED))
def _(spark, sf):
    results = scratch_path(spark, "results")
    requests = a.email_requests(spark, sf)
    store = SummaryStore(spark, scratch_path(spark, "store"))
    store.write(a.summaries(spark, sf))
    stream = _landed(spark, [requests.where(f"seq % 3 = {part}") for part in range(3)], requests.schema)
    streams.stream_summarize(
        stream, store, {"length": length_model}, lambda: AS_OF, scratch_path(spark, "stream-state"),
        results, available_now=True).awaitTermination()
    return spark.read.parquet(results).drop("batch")
