"""Field expressions: fall-backs, epochs, sizes and display labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from ..columns import as_column, quoted
from .text import strip


def non_blank(value: Column | str) -> Column:
    """The value, or NULL where it is the empty string."""
    return F.nullif(as_column(value), F.lit(""))


def first_truthy(*values: Column | str) -> Column:
    """First value that is neither missing nor empty; the last one is taken as it is."""
    *earlier, last = (as_column(v) for v in values)
    return F.coalesce(*[non_blank(v) for v in earlier], last)


def absent_default(value: Column | str, default: str) -> Column:
    """The default only where the field is absent; an empty string stays."""
    return F.coalesce(as_column(value), F.lit(default))


def is_truthy(value: Column | str) -> Column:
    return F.coalesce(as_column(value) != "", F.lit(False))


def event_id(uid: Column | str, own_id: Column | str, calendar: Column | str,
             title: Column | str, start: Column | str) -> Column:
    """uid, else id, else ``calendar:title:start``."""
    parts = [F.coalesce(as_column(c), F.lit("")) for c in (calendar, title, start)]
    return first_truthy(uid, own_id, F.concat_ws(":", *parts))


def export_chat_id(chat_id: Column | str, chat_name: Column | str) -> Column:
    """An empty chat id is replaced by the chat's name."""
    return first_truthy(chat_id, F.coalesce(as_column(chat_name), F.lit("")))


def thread_key(chat_id: Column | str = "chat_id", chat_name: Column | str = "chat_name",
               sender: Column | str = "sender") -> Column:
    return first_truthy(chat_id, chat_name, sender, F.lit(fixed.UNKNOWN_KEY))


def thread_title(chat_name: Column | str = "chat_name", sender: Column | str = "sender") -> Column:
    return first_truthy(chat_name, sender, F.lit(fixed.UNKNOWN))


def _is_outgoing(direction: Column | str) -> Column:
    return F.coalesce(F.lower(as_column(direction)) == fixed.OUTGOING, F.lit(False))


def own_label(sender: Column | str = "sender", direction: Column | str = "direction") -> Column:
    """Sender column where the owner's outgoing, unnamed messages read ``Me``."""
    sender = as_column(sender)
    return F.when(~is_truthy(sender) & _is_outgoing(direction), fixed.OWN_LABEL).otherwise(sender)


def speaker(sender: Column | str = "sender", direction: Column | str = "direction") -> Column:
    """Who a transcript line is attributed to."""
    absent = F.when(_is_outgoing(direction), fixed.OWN_LABEL).otherwise(fixed.UNKNOWN)
    return first_truthy(sender, absent)


def parse_epoch(value: Column | str) -> Column:
    """Epoch seconds from digits or from ``2024-02-03 01:02:03``; 0 for anything else.

    Numbers are cut to whole seconds.  The single-letter pattern also reads
    ``2024-2-3 1:2:3``.  ``try_`` functions keep one bad row from ending the job.
    """
    text = strip(as_column(value).cast("string"))
    moment = F.try_to_timestamp(F.regexp_replace(text, r"\s+", " "), F.lit("yyyy-M-d H:m:s"))
    return F.coalesce(
        F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")).otherwise(F.unix_timestamp(moment)),
        F.lit(0).cast("bigint"),
    )


def number_epoch(value: Column | str) -> Column:
    """Epoch seconds of a numeric column: the fraction is cut, missing becomes 0."""
    return F.coalesce(as_column(value).try_cast("bigint"), F.lit(0).cast("bigint"))


def to_int_or_zero(value: Column | str) -> Column:
    text = strip(as_column(value).cast("string"))
    whole = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def epoch_from_2001(date: Column | str, nanos: Column | bool) -> Column:
    """Unix seconds from a count that starts in 2001, in seconds or nanoseconds."""
    date = as_column(date).cast("bigint")
    nanos = F.lit(nanos) if isinstance(nanos, bool) else nanos
    per_second = F.lit(fixed.NANOS_PER_SECOND).cast("bigint")
    whole = F.when(nanos, F.call_function("div", date, per_second)).otherwise(date)
    return whole + F.lit(fixed.SECONDS_1970_TO_2001).cast("bigint")


def iso_text(moment: Column | str) -> Column:
    return F.date_format(as_column(moment), "yyyy-MM-dd HH:mm:ss")


def utf16_length(text: Column | str) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(as_column(text), "UTF-16BE")) / 2).cast("bigint")


def estimated_tokens(body_length: Column | str) -> Column:
    return F.ceil(as_column(body_length) / 4).cast("bigint")


def size_tier(tokens: Column | str) -> Column:
    tokens = as_column(tokens)
    return F.when(tokens > fixed.LARGE_TOKENS, "Large").when(tokens > fixed.MEDIUM_TOKENS, "Medium")


def with_sizes(emails):
    """Adds ``body_length``, ``estimated_tokens`` and ``size_tier``; empty bodies have none."""
    return (
        emails.withColumn("body_length", utf16_length(non_blank("body")))
        .withColumn("estimated_tokens", estimated_tokens("body_length"))
        .withColumn("size_tier", size_tier("estimated_tokens"))
    )


def token_budget(prompt: Column | str, cap: int = fixed.TOKEN_CAP) -> Column:
    """Answer length allowed for a prompt, from its length in characters."""
    length = F.length(as_column(prompt)).cast("bigint")
    estimate = F.greatest(F.lit(1).cast("bigint"), F.floor(length / 4))
    answer = F.greatest(F.lit(fixed.TOKEN_FLOOR).cast("bigint"), F.floor(estimate / 2))
    return F.least(F.lit(cap).cast("bigint"), answer)


def date_label(moment: Column | str) -> Column:
    """A date as shown in lists."""
    return F.coalesce(iso_text(moment), F.lit(fixed.UNKNOWN_DATE))


def text_date_label(text: Column | str) -> Column:
    return first_truthy(text, F.lit(fixed.UNKNOWN_DATE))


def email_labels(emails):
    """List row of a mail: subject, sender, date and size label."""
    return emails.select(
        "*",
        first_truthy("subject", F.lit(fixed.NO_SUBJECT)).alias("subject_label"),
        first_truthy(quoted("from"), F.lit(fixed.UNKNOWN)).alias("from_label"),
        date_label("date").alias("date_label"),
    )


def event_labels(events):
    return events.select(
        "*",
        first_truthy("title", F.lit(fixed.UNTITLED_EVENT)).alias("title_label"),
        first_truthy("calendar", F.lit(fixed.DEFAULT_CALENDAR)).alias("calendar_label"),
        date_label("start").alias("date_label"),
    )


def reminder_labels(reminders):
    return reminders.select(
        "*",
        first_truthy("title", F.lit(fixed.UNTITLED_REMINDER)).alias("title_label"),
        first_truthy(quoted("list"), F.lit(fixed.DEFAULT_REMINDER_LIST)).alias("list_label"),
        date_label("due").alias("date_label"),
    )


def thread_labels(threads):
    return threads.select(
        "*",
        first_truthy("title", F.lit(fixed.UNKNOWN)).alias("title_label"),
        text_date_label("last_date").alias("date_label"),
        F.coalesce(F.col("last_message"), F.lit("")).alias("preview_label"),
    )
