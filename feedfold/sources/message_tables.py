"""The relational message source and the choice between two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..columns import By, Instant, by_columns
from ..functions.fields import epoch_from_2001, first_truthy, iso_text
from ..operators.filters import non_empty_text, possibly_recent, raw_cutoff, recent_raw
from ..operators.joins import split_join
from ..operators.ranking import as_arrival_order, first_n
from ..operators.threads import join_message_tables


def message_projection(joined: DataFrame, nanos: Column, by: By = (), seq: str = "seq") -> DataFrame:
    """Joined message rows as messages, with fall-backs for id, name and sender."""
    mine = F.coalesce(F.col("is_from_me") == 1, F.lit(False))
    unknown = F.lit(fixed.UNKNOWN)
    moment = epoch_from_2001("date", nanos)
    return joined.select(
        *by_columns(by), seq,
        first_truthy("chat_identifier", "handle_id", F.col("message_id").cast("string")).alias("chat_id"),
        first_truthy("display_name", "handle_id", unknown).alias("chat_name"),
        F.when(mine, fixed.OWN_LABEL).otherwise(first_truthy("handle_id", unknown)).alias("sender"),
        F.when(mine, fixed.OUTGOING).otherwise(fixed.INCOMING).alias("direction"),
        iso_text(F.timestamp_seconds(moment)).alias("date"),
        moment.alias("timestamp"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _recent_with_unit(message: DataFrame, as_of: Instant, hours: int, by: By) -> DataFrame:
    """Messages inside the window with ``_nanos``: whether their dates count nanoseconds."""
    is_nanos = F.coalesce(F.max("date") > F.lit(fixed.NANOS_THRESHOLD).cast("bigint"), F.lit(False))
    candidates = message.where(possibly_recent(as_of, hours))
    if by:
        # Each account may come from a different store, so each has its own unit.
        # A date above the threshold shows it; the others have to ask.
        units = message.groupBy(*by_columns(by)).agg(is_nanos.alias("_nanos"))
        shown = F.col("date") > fixed.NANOS_THRESHOLD
        asking = split_join(candidates.where(~shown), units, list(by), "inner")
        known = candidates.where(shown).withColumn("_nanos", F.lit(True)).unionByName(asking)
    else:
        known = candidates.withColumn("_nanos", message.agg(is_nanos.alias("nanos")).scalar())
    return recent_raw(known, raw_cutoff(as_of, hours, F.col("_nanos")))


def read_message_tables(message: DataFrame, handle: DataFrame, chat_message_join: DataFrame,
                        chat: DataFrame, as_of: Instant, hours: int, count: int,
                        by: By = ()) -> DataFrame:
    """Newest ``count`` joined rows of the window, as messages.

    The cap counts joined rows.  Every message gives at least one, so the newest
    ``count`` messages are enough to fill it: they are picked *before* the joins,
    which then handle a few rows instead of the whole table.
    """
    wanted = non_empty_text(_recent_with_unit(message, as_of, hours, by))
    newest = first_n(wanted, count, [F.desc("date"), "rowid"], by).drop("rank")
    joined = join_message_tables(newest, handle, chat_message_join, chat, by, keep=["_nanos"])
    order = [F.desc("date"), "message_id", F.asc_nulls_first("chat_rowid")]
    capped = as_arrival_order(first_n(joined, count, order, by))
    return message_projection(capped, F.col("_nanos"), by)


def with_fallback(primary: DataFrame, secondary: DataFrame, by: By = (),
                  enabled: bool = True, failed: bool = False) -> DataFrame:
    """The primary rows, or the secondary rows where there are no primary ones.

    ``enabled`` switches this off for a primary source that is merely empty; one that
    ``failed`` is always replaced.
    """
    if not enabled and not failed:
        return primary
    if by:
        have = primary.select(*by_columns(by)).distinct()
        spare = split_join(secondary, have, list(by), "left_anti")
    else:
        # Asks for one primary row; nothing is counted.
        spare = secondary.where(~primary.exists())
    return primary.unionByName(spare)


def fallback_enabled(setting: str | None) -> bool:
    """Reads the switch for ``with_fallback``: on unless set to something else than yes."""
    return (setting if setting is not None else "1").lower() in ("1", "true", "yes")
