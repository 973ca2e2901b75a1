"""Recent messages as threads, latest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..columns import By, Instant
from ..operators.filters import recent
from ..operators.ranking import as_arrival_order, newest_n, threads_by_recency
from ..operators.threads import collect_thread_messages, thread_rollup


def recent_messages(messages: DataFrame, as_of: Instant, hours: int = 48, count: int = 200,
                    by: By = ()) -> DataFrame:
    """The newest ``count`` messages of the window; ``seq`` becomes their rank."""
    windowed = recent(messages, as_of, hours)
    return as_arrival_order(newest_n(windowed, count, by, ts="timestamp"))


def message_threads(messages: DataFrame, as_of: Instant, hours: int = 48, count: int = 200,
                    by: By = ()) -> DataFrame:
    """Flat thread rows (no nested messages)."""
    newest = recent_messages(messages, as_of, hours, count, by)
    return threads_by_recency(thread_rollup(newest, by), by)


def message_threads_nested(messages: DataFrame, as_of: Instant, hours: int = 48, count: int = 200,
                           by: By = ()) -> DataFrame:
    """Threads with their nested, time-ordered messages."""
    newest = recent_messages(messages, as_of, hours, count, by)
    return threads_by_recency(collect_thread_messages(newest, None, by), by)


def thread_count(threads: DataFrame) -> DataFrame:
    return threads.agg(F.count(F.lit(1)).alias("count"))
