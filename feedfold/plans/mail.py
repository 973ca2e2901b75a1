"""Mail lists and the search for one mail."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..columns import By, Instant, by_columns, quoted
from ..operators.filters import look_back
from ..operators.ranking import cap_by_arrival, first_n
from ..operators.summaries import with_has_summary


def recent_emails(emails: DataFrame, store: DataFrame, as_of: Instant, hours: int = 24,
                  count: int = 10, by: By = ()) -> DataFrame:
    """The first ``count`` mails of the window and whether each has a summary."""
    return with_has_summary(cap_by_arrival(look_back(emails, as_of, hours), count, by), store, by)


def find_email(emails: DataFrame, wanted: DataFrame, as_of: Instant, by: By = (),
               hours: int = fixed.FIND_EMAIL_HOURS, count: int = fixed.FIND_EMAIL_ROWS) -> DataFrame:
    """Per wanted ``(subject, sender)`` the first mail with both, among the first
    ``count`` of the window; pairs without one give no row."""
    pool = cap_by_arrival(look_back(emails, as_of, hours), count, by).drop("rank")
    pairs = wanted.select(
        *by_columns(by), F.col("subject").alias("_subject"), F.col("sender").alias("_sender")
    ).distinct()
    on = (pool["subject"] == F.col("_subject")) & (quoted("from") == F.col("_sender"))
    if by:
        renamed = pairs.withColumnsRenamed({c: f"_by_{c}" for c in by})
        for c in by:
            on &= pool[c] == F.col(f"_by_{c}")
        found = pool.join(renamed, on).drop(*[f"_by_{c}" for c in by])
    else:
        found = pool.join(pairs, on)
    found = found.drop("_subject", "_sender")
    return first_n(found, 1, ["seq"], [*by, "subject", "from"]).drop("rank")
