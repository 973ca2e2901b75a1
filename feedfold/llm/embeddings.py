"""Near-duplicate vectors by an exact metric range join.

Pivots part the unit vectors of a label into cells of their nearest pivot.  For x in the
cell of p and y in that of q, |x - y| is at least the sum of their distances to the plane
between p and q; so one end of a pair within the radius is within half the radius of
that plane, and such vectors are also sent to the cell beyond it.  Cells are then joined by
themselves, in tiles, and give counts and spanning links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, groups, tidy, tied, written
from .components import components

TILE = 1024
LABELS, PIVOTS = 512, 4_096  # labels that get pivots, pivots of all of them: the rest are cells of their own
SINGLE = 1_024  # a label of fewer vectors is one cell
SLACK = 1e-9


def pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit pivots for the largest keys, about sqrt(n) / 4 of each, at most PIVOTS in all; any choice gives the same links."""
    sizes = vectors.groupBy("key").count().where(F.col("count") >= SINGLE).orderBy(F.desc("count"), "key").limit(LABELS).collect()
    wish = {r.key: math.ceil(math.sqrt(r["count"]) / 4) for r in sizes}
    less = min(1.0, PIVOTS / max(1, sum(wish.values())))
    wish = {k: max(2, int(n * less)) for k, n in wish.items()}
    shares = [(r.key, min(1.0, 4 * wish[r.key] / r["count"])) for r in sizes]
    if not shares:
        return {}
    share = vectors.sparkSession.createDataFrame(shares, "key long, share double")
    luck = (F.pmod(F.xxhash64("node", "v"), F.lit(2**31)) / F.lit(float(2**31))).alias("luck")
    rows = vectors.join(F.broadcast(share), "key").select("key", "v", "share", luck).where("luck < share").collect()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.key, r.luck)):
        if len(found.setdefault(r.key, [])) < wish[r.key]:
            found[r.key].append(r.v)
    out = {}
    for key, chosen in found.items():
        v = np.array(chosen, np.float64)
        out[key] = np.unique(v / np.linalg.norm(v, axis=1, keepdims=True), axis=0)
    return out


def _place(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], radius: float) -> Iterator[pa.RecordBatch]:
    """Each vector in its cell and in those whose border is within half the radius."""
    for batch in batches:
        keys = batch.column("key").to_numpy()
        rows, cells, home, beyond = [], [], [], []
        for key in np.unique(keys):
            own = np.flatnonzero(keys == key)
            p = pivots.get(int(key))
            if p is None:
                near, sent = np.zeros(len(own), np.int64), np.ones((len(own), 1), bool)
            else:
                v = np.stack(batch.column("v").take(pa.array(own)).to_numpy(zero_copy_only=False))
                dots = v / np.linalg.norm(v, axis=1, keepdims=True) @ p.T
                near = dots.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 1e-30))
                to_plane = (dots[np.arange(len(own)), near][:, None] - dots) / apart[near]
                sent = to_plane <= radius / 2 + SLACK
                sent[np.arange(len(own)), near] = True
            r, c = np.nonzero(sent)
            others = [np.flatnonzero(s) for s in sent]
            rows.append(own[r]), cells.append(c), home.append(near[r])
            beyond += [others[x] for x in r]
        rows = np.concatenate([np.empty(0, np.int64), *rows])
        if not len(rows):
            continue
        ints = lambda parts: pa.array(np.concatenate(parts), pa.int32())
        taken = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays([*taken.columns, ints(cells), ints(home), pa.array(beyond, pa.list_(pa.int32()))],
                                         [*batch.schema.names, "cell", "home", "sent"])


def _join(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of each tile: how many vectors each one is linked with (a, null, its hash, n), and links
    that tie the same groups (a, b)."""
    for tile in groups(batches, ["key", "cell", "i", "j"]):
        cell, i, j = (tile[k][0].as_py() for k in ("cell", "i", "j"))
        own, home, node = (tile[k].to_numpy() for k in ("own", "home", "node"))
        times = tile["times"].to_numpy().astype(np.float64)
        v = np.stack(tile["v"].to_numpy())
        norm = np.linalg.norm(v, axis=1)
        unit = v / norm[:, None]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        cosine = unit[left] @ unit[right].T
        for x, y in np.argwhere(np.abs(cosine - least) < SLACK):
            a, b = left[x], right[y]
            cosine[x, y] = np.dot(v[a], v[b]) / (norm[a] * norm[b])
        linked = (cosine >= least) & (node[left][:, None] != node[right][None, :])
        here = home == cell
        linked &= here[left][:, None] | here[right][None, :]
        # A pair of which each end was sent to the other's cell counts in the cell of the lesser number.
        cells = max(int(home.max()), cell) + 1
        sent = np.zeros((len(node), cells), bool)
        for row, places in enumerate(tile["sent"].to_pylist()):
            sent[row, [c for c in places if c < cells]] = True
        twice = here[left][:, None] & ~here[right][None, :] & sent[left][:, home[right]] & (home[right] < cell)[None, :]
        twice |= here[right][None, :] & ~here[left][:, None] & sent[right][:, home[left]].T & (home[left] < cell)[:, None]
        linked &= ~twice
        n = np.zeros(len(node))
        n[left] += linked @ times[right]
        if i != j:
            n[right] += linked.T @ times[left]
        some = np.flatnonzero(n)
        ties = tied(linked, node[left], node[right])
        yield pa.RecordBatch.from_arrays(
            [pa.array([*node[some].tolist(), *(a for a, _ in ties)], pa.int64()),
             pa.array([*[None] * len(some), *(b for _, b in ties)], pa.int64()),
             pa.array([*tile["vh"].to_numpy()[some].tolist(), *[0] * len(ties)], pa.int64()),
             pa.array([*n[some].astype(np.int64).tolist(), *[0] * len(ties)], pa.int64())], ["a", "b", "vh", "n"])


def near_vectors(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """Per row: id, n_links (other vectors at a cosine of ``least`` or more under the same label), component_id
    (least id reachable by links), kept (id = component_id).

    Cosines are in double precision. Vectors of other lengths are compared with their like only. A
    vector that is null, empty, zero or holds null or non-finite numbers, one without label, and
    one without id link with nothing; without id, component and kept are null. Equal vectors
    of a label are joined once and counted as often as they have ids. Repeated rows are one vector; rows of one id with
    different vectors are one vertex, whose links are added up. Other columns are ignored; an empty
    table gives no rows.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"),
                       F.col(label_col).cast("string").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = rows.where("id is not null and label is not null and size(v) > 0").where(
        F.forall("v", finite)).where(F.exists("v", lambda x: x != 0)).distinct()
    # Powers of two bring every vector near one, so that squares neither overflow nor vanish.
    most = F.array_max(F.transform("v", F.abs))
    power = F.floor(F.log2(most))
    half = F.floor(power / 2)  # in two whole steps, as one factor alone could overflow
    first, second = F.pow(F.lit(2.0), -half.cast("double")), F.pow(F.lit(2.0), (half - power).cast("double"))
    good = good.withColumn("v", F.transform("v", lambda x: x * first * second))
    vectors = written(good.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("times")).select(
        F.xxhash64("label", F.size("v")).alias("key"), F.xxhash64("label", "v").alias("vh"), "label", "v", "node", "times"), "vectors")
    copies = good.join(vectors.where("times > 1").select("label", "v", "node", "vh"), ["label", "v"]).where(
        "id <> node").select("id", "node", "vh")

    chosen, radius = pivots(vectors), math.sqrt(2 - 2 * least)
    placed = vectors.select("key", "v", "node", "vh", "times").mapInArrow(
        tidy(lambda it: _place(it, chosen, radius)),
        "key long, v array<double>, node long, vh long, times long, cell int, home int, sent array<int>")
    placed = written(placed, "cells")
    sizes = placed.groupBy("key", "cell").agg(F.count("*").alias("m")).where("m > 1").select(
        fresh("key").alias("key"), "cell", F.ceil(F.col("m") / TILE).cast("int").alias("c"))
    tiles = placed.join(sizes, ["key", "cell"]).withColumn(
        "own", F.pmod(F.xxhash64("node", "v"), F.col("c").cast("long")).cast("int"))
    tiles = tiles.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o")).select(
        "key", "cell", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "vh", "times", "home",
        "sent", "v")
    found = written(tiles.repartition("key", "cell", "i", "j").sortWithinPartitions("key", "cell", "i", "j").mapInArrow(
        tidy(lambda it: _join(it, least)), "a long, b long, vh long, n long"), "vector-links")

    label = components(found.where("b is not null").select("a", "b").unionByName(copies.select(F.col("id").alias("a"), F.col("node").alias("b"))))
    beyond = found.where("b is null").select(F.col("a").alias("node"), "vh", "n")
    counts = vectors.select("node", "vh", (F.col("times") - 1).alias("n")).unionByName(beyond)
    counts = counts.groupBy("node", "vh").agg(F.sum("n").alias("n"))
    members = copies.unionByName(vectors.select(F.col("node").alias("id"), "node", "vh"))
    counts = members.join(counts, ["node", "vh"]).groupBy("id").agg(F.sum("n").alias("n"))
    out = rows.select("id").join(counts, "id", "left").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (F.col("id") == component).alias("kept"))
