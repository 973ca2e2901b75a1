"""Joins that stay spread when one key holds many of the rows.

AQE splits a skewed partition only if both sides of the join come straight from a
shuffle the join asked for.  A side that was grouped by the key before needs no
such shuffle, and then one task gets the whole hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..columns import as_column, quoted


def fresh_key(key: Column | str) -> Column:
    """A key of any simple type as a new text expression: however the rows were partitioned before,
    the join shuffles them itself, in the shape AQE can split."""
    return F.concat(as_column(key).cast("string"), F.lit(""))


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join of many rows with few narrow ones that were grouped by the key before (one per key, say).

    For join types that keep rows of the left side only, or matches.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a {how} join cannot be split")
    keys = [fresh_key(quoted(c)).alias(f"_key{i}") for i, c in enumerate(on)]
    few = right.select(*keys, *[quoted(c) for c in right.columns if c not in on])
    same = reduce(Column.__and__, [quoted(c).cast("string") == F.col(f"_key{i}") for i, c in enumerate(on)])
    return left.join(few, same, how).drop(*[f"_key{i}" for i in range(len(on))])
