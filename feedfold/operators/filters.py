"""Time windows and row checks.

All cut-offs are constants over plain columns, so the scan gets them as pushed
filters and row groups outside the window are never read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..columns import Instant, days, hours, instant, quoted
from ..functions.fields import is_truthy


def look_back(df: DataFrame, as_of: Instant, hours_back: int, column: str = "date") -> DataFrame:
    """Rows after ``as_of - hours_back``; the edge is out, later rows stay."""
    return df.where(quoted(column) > instant(as_of) - hours(hours_back))


def look_ahead(df: DataFrame, as_of: Instant, days_ahead: int, column: str = "start") -> DataFrame:
    """Rows strictly between now and ``days_ahead`` days from now."""
    now = instant(as_of)
    return df.where((quoted(column) > now) & (quoted(column) < now + days(days_ahead)))


def due_window(df: DataFrame, as_of: Instant, days_ahead: int, column: str = "due") -> DataFrame:
    """Rows from today's midnight up to, not including, ``days_ahead`` days later."""
    midnight = F.date_trunc("day", instant(as_of))
    return df.where((quoted(column) >= midnight) & (quoted(column) < midnight + days(days_ahead)))


def recent(df: DataFrame, as_of: Instant, hours_back: int, column: str = "timestamp") -> DataFrame:
    """Epoch-second rows of the last hours, both edges in; undated and future rows go."""
    now = F.unix_timestamp(instant(as_of))
    return df.where(quoted(column).between(now - F.lit(hours_back * 3600), now))


def raw_cutoff(as_of: Instant, hours_back: int, nanos: Column) -> Column:
    """The start of the window in the unit of a 2001-based date column."""
    seconds = (
        F.unix_timestamp(instant(as_of))
        - F.lit(hours_back * 3600).cast("bigint")
        - F.lit(fixed.SECONDS_1970_TO_2001).cast("bigint")
    )
    return seconds * F.when(nanos, F.lit(fixed.NANOS_PER_SECOND).cast("bigint")).otherwise(1)


def possibly_recent(as_of: Instant, hours_back: int, column: str = "date") -> Column:
    """A test by constants for rows that may be recent in either unit.

    A date above the threshold proves nanoseconds.  The scan can use this before
    the unit is known; ``recent_raw`` decides.
    """
    date, threshold = quoted(column), F.lit(fixed.NANOS_THRESHOLD).cast("bigint")
    fine = raw_cutoff(as_of, hours_back, F.lit(True))
    coarse = raw_cutoff(as_of, hours_back, F.lit(False))
    return ((date > threshold) & (date >= fine)) | (
        (date <= threshold) & (date >= F.least(fine, coarse))
    )


def recent_raw(df: DataFrame, cutoff: Column, column: str = "date") -> DataFrame:
    """Rows at or after the cut-off in the source's own unit; future rows stay."""
    return df.where(quoted(column) >= cutoff)


def open_only(df: DataFrame, column: str = "completed") -> DataFrame:
    return df.where(~quoted(column))


def non_empty_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.where(quoted(column).isNotNull() & (quoted(column) != ""))


def drop_bad_records(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Convert text columns to ``types``; a row with a value that cannot be read is
    left out alone, all others survive.  Missing values are not bad."""
    good = F.lit(True)
    converted = {}
    for column, kind in types.items():
        value = quoted(column).try_cast(kind)
        good &= quoted(column).isNull() | value.isNotNull()
        converted[column] = value
    return df.where(good).withColumns(converted)


def _given(column: str) -> Column:
    return is_truthy(quoted(column))


def request_error(form: str) -> Column:
    """The reason a request cannot be served, or NULL.

    Forms: ``email_summary`` (body), ``item_summary`` (kind, content),
    ``email_question`` (question, body), ``item_question`` (kind, content, question).
    """
    if form == "email_summary":
        return F.when(~_given("body"), fixed.ERROR_NO_BODY)
    if form == "item_summary":
        known = F.col("kind").isin(*fixed.ITEM_PROMPT)
        return F.when(~_given("kind") | ~_given("content"), fixed.ERROR_ITEM).when(
            ~known, F.concat(F.lit(fixed.ERROR_KIND), F.col("kind"))
        )
    if form == "email_question":
        return F.when(~_given("question") | ~_given("body"), fixed.ERROR_EMAIL_QUESTION)
    if form == "item_question":
        missing = ~_given("kind") | ~_given("content") | ~_given("question")
        return F.when(missing, fixed.ERROR_ITEM_QUESTION)
    raise ValueError(f"unknown request form: {form}")


def check_requests(requests: DataFrame, form: str) -> DataFrame:
    """Adds ``error``; served requests have NULL there."""
    return requests.withColumn("error", request_error(form))
