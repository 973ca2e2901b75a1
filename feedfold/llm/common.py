"""Helpers that several operators share: words, hashes and tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, purpose: str) -> DataFrame:
    """``written``, in buckets of ``key``: a join or grouping on it does not move these rows again."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    name = os.path.basename(path).replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key)
     .saveAsTable(name))
    return spark.table(name)


def fresh(column: str) -> Column:
    """A long key as a new expression, so that a join on it makes an exchange of its own that AQE can split."""
    return F.bitwise_not(F.bitwise_not(column))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none. Only A-Z are lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (xor-shifts and odd factors)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j, factor in enumerate(odd_numbers(n, n)):
        out += h[j : j + m] * factor
    return mixed(out)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows that come in order of ``keys`` (long or int columns)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys])
        starts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != v for k, v in zip(keys, values[:, 0])):
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *starts.tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:]):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, where much is made of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tied(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """The groups that a matrix of links makes, as (first, other) of each: fewer pairs than members."""
    out, free = [], links.any(axis=1)
    for first in np.flatnonzero(free):
        if not free[first]:
            continue
        rows = np.zeros(len(left), bool)
        rows[first] = True
        while True:
            columns = links[rows].any(axis=0)
            wider = rows | links[:, columns].any(axis=1)
            if (wider == rows).all():
                break
            rows = wider
        free &= ~rows
        members = np.unique(np.concatenate([left[rows], right[columns]]))
        out += [(int(members[0]), int(x)) for x in members[1:]]
    return out


def give_back() -> None:
    """Return this worker's free memory to the machine: Spark keeps workers for the next task, which may be another's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` over a task's batches, and then its memory is given back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run
