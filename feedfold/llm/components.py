"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(fresh("u").alias("u"), F.least("u", "m").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each neighbour of a node (large: the greater ones; small: the lesser ones) on its least neighbour."""
    there = edges.where("u > v")
    if large:
        near = there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = near.join(_least(near), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = there.join(_least(there), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.unionByName(_least(there).select("u", F.col("m").alias("v")))
    return hung.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of ``links`` (two long columns); a component is named by its least node.

    Null ends and self links are left out; no links give no rows.  Both stars are joins
    and minima, so no neighbourhood is ever gathered; the number of rounds grows
    with the logarithm of the number of nodes.  Each round ends in a written table.
    """
    a, b = links.columns
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        edges = written(_star(_star(edges, True), False), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
