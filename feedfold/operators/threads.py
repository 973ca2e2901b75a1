"""Message threads: relational joins, roll-up, nested lists, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..columns import By, by_columns, quoted
from ..functions.fields import own_label, speaker, thread_key, thread_title
from .ranking import as_arrival_order, first_n


def join_message_tables(message: DataFrame, handle: DataFrame, chat_message_join: DataFrame,
                        chat: DataFrame, by: By = (), keep: By = ()) -> DataFrame:
    """message, its handle and its chats by three left joins; ``keep`` names more
    columns of message.

    A message in k chats gives k rows.  No hints: Catalyst broadcasts what is
    small and AQE splits partitions that a busy handle or chat makes large.
    """
    def keyed(df: DataFrame, **names: str) -> DataFrame:
        return df.select(*by_columns(by), *[quoted(old).alias(new) for new, old in names.items()])

    left = keyed(message, message_id="rowid", date="date", text="text",
                 is_from_me="is_from_me", handle_rowid="handle_id", **{c: c for c in keep})
    handles = keyed(handle, handle_rowid="rowid", handle_id="id")
    links = keyed(chat_message_join, message_id="message_id", chat_rowid="chat_id")
    chats = keyed(chat, chat_rowid="rowid", chat_identifier="chat_identifier",
                  display_name="display_name")
    by = list(by)
    return (
        left.join(handles, [*by, "handle_rowid"], "left")
        .join(links, [*by, "message_id"], "left")
        .join(chats, [*by, "chat_rowid"], "left")
        .drop("handle_rowid")
    )


def nanos_unit(message: DataFrame) -> Column:
    """Whether the dates count nanoseconds: one global maximum as a scalar subquery."""
    is_nanos = F.coalesce(F.max("date") > F.lit(fixed.NANOS_THRESHOLD).cast("bigint"), F.lit(False))
    return message.agg(is_nanos.alias("nanos")).scalar()


def thread_rollup(messages: DataFrame, by: By = ()) -> DataFrame:
    """One row per thread.

    The title is that of the first extracted message; the last message is the
    latest in time, among equal times the one extracted later.  All aggregates
    combine on the map side, so a thread with a third of all rows still sends one
    row per task.
    """
    latest = F.max_by(
        F.struct("text", "date", "timestamp"), F.struct("timestamp", "seq")
    )
    return (
        messages.groupBy(*by_columns(by), thread_key().alias("thread_id"))
        .agg(
            F.min_by(thread_title(), F.col("seq")).alias("title"),
            latest.alias("_latest"),
            F.count(F.lit(1)).alias("message_count"),
            F.min("seq").alias("first_seq"),
        )
        .select(
            *by_columns(by), "thread_id", "title",
            F.coalesce("_latest.text", F.lit("")).alias("last_message"),
            F.coalesce("_latest.date", F.lit("")).alias("last_date"),
            F.col("_latest.timestamp").alias("last_ts"),
            "message_count", "first_seq",
        )
    )


def thread_messages(messages: DataFrame, by: By = ()) -> DataFrame:
    """Messages with their thread and the owner's label, for any number of rows.

    The label is set after the thread and title were chosen from the raw sender.
    """
    return messages.select(
        *by_columns(by), thread_key().alias("thread_id"), thread_title().alias("title"),
        "seq", "timestamp", "date", "chat_id", "chat_name", "direction", "text",
        own_label().alias("sender"),
    )


def collect_thread_messages(messages: DataFrame, count: int | None, by: By = ()) -> DataFrame:
    """Threads of the first ``count`` messages per account with their nested lists.

    The cap is part of the operator: no list is longer than ``count``.  None says
    that the messages come from a cap already, numbered by it.
    """
    capped = messages if count is None else as_arrival_order(first_n(messages, count, ["seq"], by))
    item = F.struct("timestamp", "seq", "chat_id", "chat_name", "sender", "direction", "date", "text")
    return (
        thread_messages(capped, by)
        .groupBy(*by_columns(by), "thread_id")
        .agg(
            F.min_by("title", "seq").alias("title"),
            F.array_sort(F.collect_list(item)).alias("messages"),
            F.min("seq").alias("first_seq"),
        )
        .withColumn("_latest", F.element_at("messages", -1))
        .select(
            *by_columns(by), "thread_id", "title", "messages",
            F.coalesce("_latest.text", F.lit("")).alias("last_message"),
            F.coalesce("_latest.date", F.lit("")).alias("last_date"),
            F.col("_latest.timestamp").alias("last_ts"),
            F.size("messages").cast("bigint").alias("message_count"),
            "first_seq",
        )
    )


def transcript_of(messages: Column | str = "messages") -> Column:
    """``sender: text`` lines of a nested message list."""
    lines = F.transform(
        messages,
        lambda m: F.concat(speaker(m["sender"], m["direction"]), F.lit(": "),
                           F.coalesce(m["text"], F.lit(""))),
    )
    joined = F.array_join(lines, "\n")
    return F.when(F.coalesce(joined, F.lit("")) == "", fixed.EMPTY_TRANSCRIPT).otherwise(joined)


def transcripts(threads: DataFrame, by: By = ()) -> DataFrame:
    """Transcript per thread, from threads with nested lists."""
    return threads.select(*by_columns(by), "thread_id", "title", transcript_of().alias("transcript"))


def _preview(messages: Column, newest: bool) -> Column:
    """Texts of the last three messages in extraction order: non-empty ones, cut and joined."""
    ordered = F.reverse(messages) if newest else messages
    start = F.greatest(F.size(ordered) - fixed.PREVIEW_MESSAGES, F.lit(0)) + 1
    tail = F.slice(ordered, start, F.lit(fixed.PREVIEW_MESSAGES))
    filled = F.filter(tail, lambda m: F.coalesce(m["text"], F.lit("")) != "")
    pieces = F.transform(filled, lambda m: F.substring(m["text"], 1, fixed.PREVIEW_PIECE))
    return F.substring(F.array_join(pieces, "; "), 1, fixed.PREVIEW_TOTAL)


def digest_threads(messages: DataFrame, count: int | None = fixed.DIGEST_MESSAGE_FETCH, by: By = (),
                   newest_preview: bool = False) -> DataFrame:
    """Threads of the first ``count`` messages per account with size and preview; None: they are capped already.

    Extraction order is newest first, so the preview shows the *oldest* three
    messages of a thread; ``newest_preview`` turns that round.
    """
    capped = messages if count is None else as_arrival_order(first_n(messages, count, ["seq"], by))
    # Only the start of a text can show up in a preview.
    item = F.struct("seq", F.substring("text", 1, fixed.PREVIEW_PIECE).alias("text"))
    return (
        capped.groupBy(*by_columns(by), thread_key().alias("thread_id"))
        .agg(
            F.min_by(thread_title(), F.col("seq")).alias("title"),
            F.count(F.lit(1)).alias("message_count"),
            F.min("seq").alias("first_seq"),
            F.array_sort(F.collect_list(item)).alias("_messages"),
        )
        .withColumn("preview", _preview(F.col("_messages"), newest_preview))
        .drop("_messages")
    )
