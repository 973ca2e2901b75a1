"""Changes to the summary table and look-ups in it.

Join keys are e-mail ids, beside the columns ``by`` that separate accounts: an id is
unique only inside one mailbox.  Rows without an id never match anything; where such
rows, or requests for one mail, are many, AQE splits the partition they share.
That is why look-ups are left, semi or anti joins (an existence join cannot be
split) and why the store's side is always shuffled for them (see ``joins``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import By, by_columns, quoted
from ..functions.text import strip
from .joins import fresh_key
from .ranking import arrival_numbers, keep_first

STORED = ("id", "email_id", "subject", "sender", "email_date", "body", "summary",
          "model_used", "created_at")


def number_new(new: DataFrame, last_id: int | Column, by: By = ()) -> DataFrame:
    """Give new rows ids after ``last_id`` in arrival order, without gaps whatever gaps ``seq`` has.

    A row that is replaced at once has used up its id all the same.
    """
    last_id = last_id if isinstance(last_id, Column) else F.lit(last_id)
    numbered = arrival_numbers(new, "seq", "id")
    return numbered.withColumn("id", last_id.cast("bigint") + F.col("id")).select(*by_columns(by), *STORED)


def highest_id(store: DataFrame) -> Column:
    return store.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint")).alias("id")).scalar()


def check_insert(store: DataFrame, new: DataFrame, by: By = ()) -> None:
    """Raise if a key of ``new`` is stored already or comes twice; NULL is no key."""
    keys = new.where(F.col("email_id").isNotNull()).groupBy(*by_columns(by), "email_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    twice = keys.where("n > 1").select("email_id")
    stored = keys.join(_stored(store, by), _same_key("email_id", by), "left_semi").select("email_id")
    found = twice.union(stored).first()
    if found is not None:
        raise ValueError(f"email_id is not unique: {found[0]}")


def insert_summaries(store: DataFrame, new: DataFrame, last_id: int | None = None, by: By = ()) -> DataFrame:
    """The table with ``new`` appended."""
    check_insert(store, new, by)
    base = highest_id(store) if last_id is None else last_id
    return store.select(*by_columns(by), *STORED).unionByName(number_new(new, base, by))


def latest_per_email(rows: DataFrame, by: By = ()) -> DataFrame:
    """Of several rows with one key the one with the highest id counts; rows without key all stay."""
    keyed = keep_first(rows.where(F.col("email_id").isNotNull()), [*by, "email_id"], [F.desc("id")])
    return keyed.unionByName(rows.where(F.col("email_id").isNull()))


def without_keys(store: DataFrame, new: DataFrame, by: By = ()) -> DataFrame:
    """The rows whose keys ``new`` does not replace."""
    return store.join(_stored(new, by), _same_key("email_id", by), "left_anti")


def upsert_summaries(store: DataFrame, new: DataFrame, last_id: int | None = None, by: By = ()) -> DataFrame:
    """The table after insert-or-replace: a replaced row has the new id and time."""
    base = highest_id(store) if last_id is None else last_id
    kept = without_keys(store.select(*by_columns(by), *STORED), new, by)
    # Numbered before repeats go: also a row that is replaced at once uses up an id.
    return kept.unionByName(latest_per_email(number_new(new, base, by), by))


def delete_summaries(store: DataFrame, ids: DataFrame, by: By = ()) -> DataFrame:
    """The table without the given ids; ids that are not there do nothing.  With ``by``,
    an account's ids (with its columns) delete rows of that account only."""
    chosen = ids.select(*by_columns(by), "id")
    return store.join(chosen, [*by, "id"], "left_anti").select(*by_columns(by), *STORED)


def clear_summaries(store: DataFrame) -> DataFrame:
    """No rows, same columns."""
    return store.limit(0)


def _same_key(key: Column | str, by: By) -> Column:
    """The condition that a row's account and ``key`` are those of a row of ``_stored``."""
    key = quoted(key) if isinstance(key, str) else key
    return reduce(Column.__and__, [quoted(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], key == F.col("_key"))


def _stored(store: DataFrame, by: By, *columns: str) -> DataFrame:
    """Keyed rows of the store for a look-up; their keys are unique."""
    keyed = store.where(F.col("email_id").isNotNull())
    accounts = [quoted(c).alias(f"_by{i}") for i, c in enumerate(by)]
    return keyed.select(fresh_key("email_id").alias("_key"), *accounts, *columns, F.lit(True).alias("_hit"))


def _helpers(by: By) -> list[str]:
    return ["_key", "_hit", *[f"_by{i}" for i in range(len(by))]]


def with_has_summary(emails: DataFrame, store: DataFrame, by: By = ()) -> DataFrame:
    """Adds ``has_summary``; a mail without id is looked up as the empty id."""
    wanted = F.coalesce(F.col("id"), F.lit(""))
    found = emails.join(_stored(store, by), _same_key(wanted, by), "left")
    return found.withColumn("has_summary", F.coalesce("_hit", F.lit(False))).drop(*_helpers(by))


def cache_lookup(requests: DataFrame, store: DataFrame, by: By = ()) -> DataFrame:
    """Adds the stored ``summary`` and ``cached`` to requests with an ``email_id``."""
    found = requests.join(_stored(store, by, "summary"), _same_key("email_id", by), "left")
    return found.withColumn("cached", F.coalesce("_hit", F.lit(False))).drop(*_helpers(by))


def cache_misses(requests: DataFrame, store: DataFrame, by: By = ()) -> DataFrame:
    return requests.join(_stored(store, by), _same_key("email_id", by), "left_anti")


def select_by_id(rows: DataFrame, chosen: DataFrame, by: By = ()) -> DataFrame:
    """Rows whose ``id`` was chosen before."""
    return rows.join(chosen.select(*by_columns(by), "id"), [*by, "id"], "left_semi")


def priority_union(lists: list[DataFrame], current: DataFrame | None = None,
                   by: By = ()) -> DataFrame:
    """Ordered lists (``seq``, ``value``) one after the other, without repeats.

    Blank entries go.  ``current`` is put in front of everything if no list has
    it.  The result's order is (``priority``, ``seq``).
    """
    def tagged(entries: DataFrame, priority: int, value: Column) -> DataFrame:
        return entries.select(
            *by_columns(by), F.lit(priority).alias("priority"), "seq", value.alias("value")
        )

    parts = [tagged(entries, i, strip(F.col("value"))) for i, entries in enumerate(lists)]
    if current is not None:
        # Last in line: it is only left if no list has the same value.
        parts.append(tagged(current, len(lists), F.col("value")))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    kept = keep_first(stacked.where("value <> ''"), [*by, "value"], ["priority", "seq"])
    in_front = F.when(F.col("priority") == len(lists), -1).otherwise(F.col("priority"))
    return kept.withColumn("priority", in_front)
