"""Digest blocks per source and their union into one row per account."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..columns import By, by_columns, window_by
from ..functions.lines import email_line, event_line, reminder_line, thread_line
from .ranking import first_n, threads_by_volume

BLOCKS = {
    "emails": fixed.NO_EMAILS,
    "events": fixed.NO_EVENTS,
    "reminders": fixed.NO_REMINDERS,
    "messages": fixed.NO_MESSAGES,
}
COUNTS = {"emails": "n_emails", "events": "n_events", "reminders": "n_reminders",
          "messages": "n_threads"}


def ranked_lines(rows: DataFrame, line: Column, order: list, fetch: int, by: By = ()) -> DataFrame:
    """The first ``fetch`` rows per account as lines with their ``rank``.

    Lines are made before the cap, so only lines and sort keys are shuffled.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    narrow = rows.select(
        *by_columns(by), line.alias("line"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)]
    )
    top = first_n(narrow, fetch, [f"_k{i}" for i in range(len(keys))], by)
    return top.select(*by_columns(by), "rank", "line")


def block_text(lines: DataFrame, show: int, default: str, by: By = (),
               max_chars: int | None = None) -> DataFrame:
    """Per account the first ``show`` lines as one text, and how many rows were fetched.

    No row fetched gives the default; rows whose first line is over the budget
    give an empty text.  Groups are as small as the fetch cap.
    """
    shown = F.col("rank") <= show
    if max_chars is not None:
        running = F.sum(F.when(shown, F.length("line")).otherwise(0)).over(
            window_by(by).orderBy("rank")
        )
        lines = lines.withColumn("_running", running)
        shown = shown & (F.col("_running") <= max_chars)
    kept = F.array_sort(F.collect_list(F.when(shown, F.struct("rank", "line"))))
    text = F.array_join(F.transform(kept, lambda item: item["line"]), "\n")
    return (
        lines.groupBy(*by_columns(by))
        .agg(F.count(F.lit(1)).alias("fetched"), text.alias("_text"))
        .select(*by_columns(by),
                F.when(F.col("fetched") == 0, default).otherwise(F.col("_text")).alias("block"),
                "fetched")
    )


def email_block(emails: DataFrame, by: By = (), fetch: int = fixed.DIGEST_EMAIL_FETCH) -> DataFrame:
    lines = ranked_lines(emails, email_line(), ["seq"], fetch, by)
    return block_text(lines, fixed.DIGEST_EMAIL_SHOW, fixed.NO_EMAILS, by, fixed.DIGEST_EMAIL_CHARS)


def event_block(events: DataFrame, by: By = (), fetch: int = fixed.DIGEST_EVENT_FETCH) -> DataFrame:
    lines = ranked_lines(events, event_line(), ["start_ts", "seq"], fetch, by)
    return block_text(lines, fixed.DIGEST_EVENT_SHOW, fixed.NO_EVENTS, by)


def reminder_block(reminders: DataFrame, by: By = (),
                   fetch: int = fixed.DIGEST_REMINDER_FETCH) -> DataFrame:
    """The reminders that came first, listed by due time."""
    narrow = reminders.select(*by_columns(by), reminder_line().alias("line"), "due_ts", "seq")
    capped = first_n(narrow, fetch, ["seq"], by)
    order = window_by(by).orderBy("due_ts", "seq")
    lines = capped.select(*by_columns(by), F.row_number().over(order).alias("rank"), "line")
    return block_text(lines, fixed.DIGEST_REMINDER_SHOW, fixed.NO_REMINDERS, by)


def message_block(digest_threads: DataFrame, by: By = (),
                  threads: int = fixed.DIGEST_THREADS) -> DataFrame:
    """Block of the largest threads (see ``threads.digest_threads``)."""
    top = threads_by_volume(digest_threads, threads, by)
    lines = top.select(*by_columns(by), "rank", thread_line().alias("line"))
    return block_text(lines, threads, fixed.NO_MESSAGES, by, fixed.DIGEST_MESSAGE_CHARS)


def source_counts(sources: Mapping[str, DataFrame], by: By = ()) -> DataFrame:
    """Rows per source side by side; counted where they are before anything moves."""
    counted = None
    for name, rows in sources.items():
        part = rows.groupBy(*by_columns(by)).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(*by_columns(by), F.lit(name).alias("source"), "n")
        counted = part if counted is None else counted.unionByName(part)
    return counted.groupBy(*by_columns(by)).agg(*[
        F.coalesce(F.sum(F.when(F.col("source") == name, F.col("n"))), F.lit(0)).alias(f"n_{name}")
        for name in sources
    ])


def digest_join(blocks: Mapping[str, DataFrame], by: By = ()) -> DataFrame:
    """One row per account with four blocks and four counts.

    Stacked and regrouped instead of three outer joins: one shuffle of at most
    four rows per account, and without ``by`` no cross join.  An account that one
    source does not know has that source's default text.
    """
    stacked = None
    for name in BLOCKS:
        part = blocks[name].select(*by_columns(by), F.lit(name).alias("source"), "block", "fetched")
        stacked = part if stacked is None else stacked.unionByName(part)
    pick = [
        F.coalesce(F.max(F.when(F.col("source") == name, F.col("block"))), F.lit(default)).alias(name)
        for name, default in BLOCKS.items()
    ] + [
        F.coalesce(F.max(F.when(F.col("source") == name, F.col("fetched"))), F.lit(0)).alias(count)
        for name, count in COUNTS.items()
    ]
    return stacked.groupBy(*by_columns(by)).agg(*pick)
