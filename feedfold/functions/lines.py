"""Text lines of the digest and labelled contents of single items."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from ..columns import as_column, let, quoted
from .fields import absent_default, first_truthy, is_truthy, iso_text
from .text import strip


def email_line(sender: Column | str | None = None, subject: Column | str = "subject",
               body: Column | str = "body") -> Column:
    """``- From: F, Subject: S - BODY...`` with the body's first characters on one line."""
    sender = quoted("from") if sender is None else as_column(sender)
    start = F.substring(F.coalesce(as_column(body), F.lit("")), 1, fixed.EMAIL_LINE_BODY)
    return F.concat(
        F.lit("- From: "), absent_default(sender, fixed.UNKNOWN),
        F.lit(", Subject: "), absent_default(subject, fixed.NO_SUBJECT),
        let(strip(F.replace(start, F.lit("\n"), F.lit(" "))), lambda text: F.when(
            text != "", F.concat(F.lit(" - "), text, F.lit("..."))).otherwise("")),
    )


def event_line(title: Column | str = "title", start: Column | str = "start",
               location: Column | str = "location") -> Column:
    place = F.concat(F.lit(" ("), as_column(location), F.lit(")"))
    return F.concat(
        F.lit("- "), absent_default(title, fixed.UNTITLED),
        F.lit(" at "), F.coalesce(iso_text(start), F.lit(fixed.DEFAULT_START)),
        F.when(is_truthy(location), place).otherwise(""),
    )


def reminder_line(title: Column | str = "title", due: Column | str = "due") -> Column:
    due = iso_text(due)
    return F.concat(
        F.lit("- "), absent_default(title, fixed.UNTITLED),
        F.when(due.isNotNull(), F.concat(F.lit(" (due: "), due, F.lit(")"))).otherwise(""),
    )


def thread_line(title: Column | str = "title", count: Column | str = "message_count",
                preview: Column | str = "preview") -> Column:
    return F.concat(
        F.lit("- "), absent_default(title, fixed.UNKNOWN), F.lit(" ("),
        as_column(count).cast("string"), F.lit(" messages): "), as_column(preview), F.lit("..."),
    )


def _optional(label: str, value: Column | str) -> Column:
    return F.when(is_truthy(value), F.concat(F.lit(label), as_column(value)))


def event_content() -> Column:
    """Labelled text of one event; location and notes only where given."""
    unknown = F.lit(fixed.UNKNOWN)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Calendar: "), first_truthy("calendar", F.lit(fixed.DEFAULT_CALENDAR))),
        F.concat(F.lit("Start: "), F.coalesce(iso_text("start"), unknown)),
        F.concat(F.lit("End: "), F.coalesce(iso_text(quoted("end")), unknown)),
        _optional("Location: ", "location"),
        _optional("Notes: ", "notes"),
    )


def reminder_content() -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("List: "), first_truthy(quoted("list"), F.lit(fixed.DEFAULT_REMINDER_LIST))),
        F.concat(F.lit("Due: "), F.coalesce(iso_text("due"), F.lit(fixed.DEFAULT_DUE))),
        _optional("Notes: ", "notes"),
    )
