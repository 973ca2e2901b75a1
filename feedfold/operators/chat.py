"""The last turns of a conversation as context for a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed
from ..columns import By, as_column, by_columns, quoted
from ..functions.fields import is_truthy

SPAN = 10_000


def _trailing(rows: DataFrame, keys: list[Column], order: str, n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), Window.currentRow)
    return rows.withColumn("_lines", F.collect_list("_line").over(window))


def trailing_lines(turns: DataFrame, line: Column, n: int, key: str = "conv_id",
                   order: str = "turn", by: By = (), span: int = SPAN) -> DataFrame:
    """Adds ``_lines``: the line of each turn and of the ``n - 1`` turns before it.

    ``order`` is the turn's position (unique in its conversation; gaps do no harm,
    NULL comes first).  A conversation is worked on in spans of ``span`` positions,
    so one that holds a third of all rows is spread over many tasks.  The first
    turns of a later span need turns of earlier ones: in conversations of several
    spans the first and last ``n - 1`` turns of each get their lines from a second
    window.  There is one plan for all sizes; rows without key are one conversation.
    """
    keys = [*by, key]
    place = F.floor(quoted(order) / span).cast("bigint")
    marked = turns.withColumn("_line", line).withColumn("_span", F.coalesce(place, F.lit(-(2**63))))
    inside = Window.partitionBy(*by_columns(keys), "_span")
    spans = (
        _trailing(marked, [*by_columns(keys), F.col("_span")], order, n)
        .withColumn("_head", F.row_number().over(inside.orderBy(order)))
        .withColumn("_tail", F.row_number().over(inside.orderBy(F.desc(order))))
    )
    several = marked.groupBy(*by_columns(keys)).agg(
        F.min("_span").alias("_from"), F.max("_span").alias("_to")
    ).where("_from < _to").select(
        *[quoted(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.lit(True).alias("_several"))
    same = [quoted(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    helpers = ("_line", "_span", "_head", "_tail", "_several", *[f"_key{i}" for i in range(len(keys))])
    # The keys of long conversations may be hot on the left; a left join can be split.
    known = spans.join(several, reduce(Column.__and__, same), "left")
    again = F.col("_several").isNotNull() & (F.col("_head") < n)
    complete = known.where(~again)
    edges = known.where(again | (F.col("_several").isNotNull() & (F.col("_tail") < n)))
    heads = _trailing(edges.drop("_lines"), by_columns(keys), order, n).where(F.col("_head") < n)
    return complete.drop(*helpers).unionByName(heads.drop(*helpers))


def chat_context(turns: DataFrame, n: int = fixed.CONTEXT_TURNS, by: By = ()) -> DataFrame:
    """Adds ``conversation``: ``role: content`` lines of the last n turns, this one included."""
    line = F.concat("role", F.lit(": "), "content")
    found = trailing_lines(turns, line, n, by=by)
    return found.withColumn("conversation", F.array_join("_lines", "\n")).drop("_lines")


def chat_context_generic(turns: DataFrame, n: int = fixed.CONTEXT_TURNS, by: By = (),
                         base: str = "context") -> DataFrame:
    """Adds ``full_context``: the base context, then the last n turns as Q and A lines."""
    label = F.when(F.lower("role") == "user", F.lit("Q: ")).otherwise(F.lit("A: "))
    found = trailing_lines(turns, F.concat(label, F.col("content")), n, by=by)
    text = with_previous(base, F.array_join("_lines", "\n"))
    return found.withColumn("full_context", text).drop("_lines")


def with_previous(base: Column | str, history: Column | str) -> Column:
    """Base context and, if there is any, the previous conversation below it."""
    base, history = as_column(base), as_column(history)
    return F.when(
        is_truthy(history), F.concat(base, F.lit("\n\nPrevious conversation:\n"), history)
    ).otherwise(base)
