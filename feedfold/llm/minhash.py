"""Near-duplicate documents by b-bit MinHash: bands find candidates, bit counts thin them, full sets decide."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, groups, mixed, odd_numbers, run_hashes, tidy, tied, word_hashes, words_of, written
from .components import components

BANDS, ROWS, BITS = 32, 5, 4  # 160 minima of 4 bits: ten longs
MISSED = 1e-5  # chance that a pair at the threshold shares no band, at most
TILE = 256  # members of a bucket that are compared at once


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``words``-word shingles; a shorter text is one shingle, none is empty."""
    found = words_of(text, lower=True)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    return np.unique(run_hashes(word_hashes(found), words))


def _minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * factors).min(axis=0), out=least)
    return least


def banding(percent: int) -> tuple[int, int]:
    """Bands and their rows, of the ``BANDS * ROWS`` minima: as many rows as leave a pair at the threshold without a band
    with a chance of ``MISSED`` at most."""
    for rows in range(ROWS, 0, -1):
        bands = BANDS if percent >= 100 else math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** rows))) if percent > 0 else BANDS * ROWS + 1
        if bands * rows <= BANDS * ROWS:
            return (BANDS, ROWS) if rows == ROWS else (bands, rows)
    raise ValueError(f"{BANDS * ROWS} minima find too few of the pairs of similarity {percent} %")


def _sign(batches: Iterator[pa.RecordBatch], words: int, count: int, rows: int) -> Iterator[pa.RecordBatch]:
    factors, mixers = odd_numbers(BANDS * ROWS, 7), odd_numbers(rows, 8)
    places = np.arange(count, dtype=np.uint64)
    shifts = (np.arange(16, dtype=np.uint64) * np.uint64(BITS))[None, :]
    for batch in batches:
        sizes, sets, sigs, bands = [], [], [], []
        for text in batch.column(1):
            shingles = shingle_set(text.as_py(), words)
            sizes.append(len(shingles))
            if not len(shingles):
                sets.append(None), sigs.append(None), bands.append(None)
                continue
            sets.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            least = _minima(shingles, factors)
            low = mixed(least) & np.uint64(2**BITS - 1)
            sigs.append((low.reshape(-1, 16) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64))
            keys = mixed((least[: count * rows].reshape(count, rows) * mixers).sum(axis=1, dtype=np.uint64) + places)
            bands.append(keys.view(np.int64))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, longs),
             pa.array(bands, longs)], ["id", "n", "set", "sig", "bands"])


def _alike(a: str, b: str) -> Column:
    """The similarity that two packed signatures show, corrected for values that are equal by chance."""
    def differing(x, y):
        z = x.bitwiseXOR(y)
        for shift in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(0x1111111111111111)))
    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return ((1 - off / F.lit(float(BANDS * ROWS))) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Six standard errors under the similarity asked for: what may still be a link."""
    n, chance = BANDS * ROWS, 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - 6 * math.sqrt(p * (1 - p) / n) / (1 - chance)


def _sides(tile: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    own = tile["own"].to_numpy()
    return np.flatnonzero(own == tile["i"][0].as_py()), np.flatnonzero(own == tile["j"][0].as_py())


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _alike_in_tiles(batches: Iterator[pa.RecordBatch], cut: float) -> Iterator[pa.RecordBatch]:
    """Groups of documents of a tile that signatures tie together across components."""
    mask, chance = np.uint64(0x1111111111111111), 2.0**-BITS
    for tile in groups(batches, ["key", "i", "j"]):
        left, right = _sides(tile)
        sig = np.concatenate([c.flatten().to_numpy() for c in tile["sig"].chunks]).view(np.uint64).reshape(tile.num_rows, -1)
        comp, node = tile["comp"].to_numpy(), tile["node"].to_numpy()
        off = np.zeros((len(left), len(right)), np.int64)
        for part in sig.T:
            z = part[left][:, None] ^ part[right][None, :]
            for shift in (1, 2):
                z |= z >> np.uint64(shift)
            off += np.bitwise_count(z & mask)
        likely = ((1 - off / (BANDS * ROWS)) - chance) / (1 - chance) >= cut
        likely &= comp[left][:, None] != comp[right][None, :]
        yield _pairs(tied(likely, node[left], node[right]))


def _linked_in_tiles(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Groups of documents of a tile that full sets link across components."""
    for tile in groups(batches, ["key", "i", "j"]):
        left, right = _sides(tile)
        comp, node = tile["comp"].to_numpy(), tile["node"].to_numpy()
        sets = [shingle_set(text.as_py(), words) for text in tile["text"]]
        sizes = np.array(list(map(len, sets)))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[place] > 1  # a shingle of one document alone is in no intersection
        column = (np.cumsum(times > 1) - 1)[place[shared]]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[shared][order]
        both = np.zeros((len(left), len(right)))
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            s, e = np.searchsorted(column, [at, at + 2048])
            has = np.zeros((len(sets), 2048), np.float32)
            has[owner[s:e], column[s:e] - at] = 1
            both += has[left] @ has[right].T
        linked = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
        linked &= comp[left][:, None] != comp[right][None, :]
        yield _pairs(tied(linked, node[left], node[right]))


def _tiled(members: DataFrame, sizes: DataFrame, carried: str) -> DataFrame:
    """Members (key, node, comp) in chunks of their group, each chunk with each: in order of the tile."""
    chunks = F.ceil(F.col("m") / TILE).cast("int")
    placed = members.join(sizes.select(fresh("key").alias("key"), chunks.alias("c")), "key").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("c").cast("long")).cast("int"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("o"))
    placed = placed.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "node", "comp",
                           "own", carried)
    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _sizes_of_mixed(members: DataFrame) -> DataFrame:
    return members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where(
        "lo <> hi")


def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if last[0] != a:
                last = (a, shingle_set(a, words))
            x, y = last[1], shingle_set(b, words)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; a text travels once for each pair it is the later one of."""
    later = pairs.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = later.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(
        tidy(lambda it: _confirm(it, words, percent)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (least id reachable by links), kept (id = component_id).

    Two documents are linked if 100 * intersection >= percent * union of their sets of
    ``words``-word shingles; all links are confirmed on full sets.  Equal sets are linked to
    their least id without comparing.  Band buckets give candidates: first each member with the
    bucket's least one; where that leaves several components in a bucket, its members are compared in
    tiles by signature, and the groups that this ties together in tiles by full sets.  Packed signatures thin candidates six standard errors below the
    similarity, and bands follow from ``percent`` (``banding``; below 7 an error), so a link is missed by chance alone
    (below 1 in 100,000 at the threshold).

    Null and empty texts have an empty set and are linked with nothing. Rows with one id are
    one vertex. A row without id is linked with nothing and has null component and kept.
    Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    count, rows = banding(percent)
    signed = written(docs.mapInArrow(tidy(lambda it: _sign(it, words, count, rows)), "id long, n long, set binary, sig array<long>, "
                                     "bands array<long>"), "minhash-signed")
    known = signed.where("id is not null and n > 0")
    firsts = written(known.groupBy("set").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "minhash-sets")
    copies = known.select("id", "set").join(firsts.where("copies > 1").select("set", "rep"), "set").where(
        "id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = written(known.join(firsts.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
                   .select("id", "sig", "bands"), "minhash-reps")

    placed = reps.select("id", F.explode("bands").alias("key"))
    hubs = placed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub <> far")
    shared = written(placed.join(hubs.select(fresh("key").alias("key"), "hub"), "key"), "minhash-shared")
    sigs = reps.select("id", "sig")
    cut = least_estimate(percent)

    tested = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    likely = tested.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b").where(
        _alike("sig_a", "sig_b") >= cut).select("a", "b")
    near = written(_verified(written(likely, "minhash-pairs"), docs, words, percent), "minhash-links")

    label = components(near).toDF("node", "component")
    comp = F.coalesce("component", "node").alias("comp")
    named = shared.select("key", F.col("id").alias("node")).join(label, "node", "left").select("key", "node", comp)
    tiles = _tiled(named.join(sigs.toDF("node", "sig"), "node"), _sizes_of_mixed(named), "sig")
    alike = components(tiles.mapInArrow(tidy(lambda it: _alike_in_tiles(it, cut)), "a long, b long"))
    named = written(alike.select(F.col("component").alias("key"), "node").join(label, "node", "left").select(
        "key", "node", comp), "minhash-groups")
    texts = docs.select(F.col("id").alias("node"), "text")
    tiles = _tiled(named.join(texts, "node"), _sizes_of_mixed(named), "text")
    late = written(tiles.mapInArrow(tidy(lambda it: _linked_in_tiles(it, words, percent)), "a long, b long"), "minhash-links")

    label = components(copies.unionByName(near).unionByName(late))
    out = signed.select("id", "n").join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      (F.col("id") == component).alias("kept"))


def keep_one_of_each(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``docs`` without those that are near-duplicates of a document with a lesser id; rows without id stay."""
    gone = near_duplicates(docs, percent, words, id_col, text_col).where("not kept").select(
        F.col(id_col).cast("long").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
