"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, Window, functions as F

By = Sequence[str]
Instant = int | str | datetime


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used.

    Inside one projection Spark would otherwise evaluate it again in every branch
    of a ``case``; on long texts that is most of the time.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def quoted(name: str) -> Column:
    """Column by exact name (``from``, ``end`` and ``list`` are SQL words)."""
    return F.col(f"`{name}`")


def instant(as_of: Instant) -> Column:
    """The moment a query is asked for, as a constant timestamp.

    Takes epoch seconds, text in session time, or a datetime that knows its zone.
    """
    if isinstance(as_of, bool):
        raise TypeError("as_of must be a moment")
    if isinstance(as_of, int):
        return F.timestamp_seconds(F.lit(as_of))
    if isinstance(as_of, datetime):
        if as_of.tzinfo is None:
            raise ValueError("a datetime without zone is ambiguous; pass text or epoch seconds")
        return F.timestamp_micros(F.lit(round(as_of.timestamp() * 1_000_000)))
    return F.to_timestamp(F.lit(as_of))


def seconds(count: int) -> Column:
    return F.make_dt_interval(secs=F.lit(count))


def hours(count: int) -> Column:
    return seconds(count * 3600)


def days(count: int) -> Column:
    return seconds(count * 86400)


def window_by(by: By) -> Window:
    return Window.partitionBy(*[quoted(c) for c in by])


def by_columns(by: By) -> list[Column]:
    return [quoted(c) for c in by]
