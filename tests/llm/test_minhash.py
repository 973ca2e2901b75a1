"""Near-duplicate groups against comparing all pairs of full shingle sets."""

import random
import re

import pytest

from feedfold.llm import minhash
from feedfold.llm.components import components


def brute(rows, percent, words=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = {}
    for n, s in enumerate(sets):
        for shingle in s:
            inverted.setdefault(shingle, []).append(n)
    pairs = {(m[0], x) for m in inverted.values() for x in m} | {
        (x, y) for m in inverted.values() if len(m) < 400 for x in m for y in m if x < y}
    for x, y in pairs:
        both = len(sets[x] & sets[y])
        if None not in (rows[x][0], rows[y][0]) and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            a, b = find(rows[x][0]), find(rows[y][0])
            root[max(a, b)] = min(a, b)
    return {(i, len(s), None if i is None else find(i), None if i is None else find(i) == i)
            for (i, _), s in zip(rows, sets)}


def edited(words, n, rnd):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"x{rnd.random()}"
    return " ".join(out)


def test_groups_edges_and_odd_rows(spark):
    rnd = random.Random(1)
    rows, k = [], 0
    for group in range(25):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([30, 120, 400]))]
        for _ in range(rnd.choice([1, 3, 12])):
            rows.append((k, edited(base, rnd.choice([0, 0, 1, 2, 4, 9]), rnd)))
            k += 7
    rows += [(5001, None), (5002, ""), (5003, " \t\n"), (5004, "a b"), (5005, "A  B"), (5006, "a b c"), (None, "a b"),
             (5007, "É ê"), (5008, "é ê"), (5009, "long " * 60_000), (5009, "long " * 60_000), (5010, "\x0cA\x0bb")]
    docs = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows],
                                 "doc_id long, text string, id string, n_shingles int, kept int")
    for percent in (80, 85):
        got = minhash.near_duplicates(docs, percent).collect()
        assert len(got) == len(rows)
        assert {tuple(r) for r in got} == brute(rows, percent)
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    gone = {i for i, *_, keep in brute(rows, 80) if keep is False}
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in rows if i not in gone)


def test_buckets_of_several_components_are_compared_in_tiles(spark, monkeypatch):
    """A chain of edits, so that many links miss a bucket's least member; tiles of three rows."""
    monkeypatch.setattr(minhash, "TILE", 3)
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(200)]
    rows = []
    for i in rnd.sample(range(100), 60):
        chained = list(words)
        for j in range(i):
            chained[j * 2] = f"z{j}"
        rows.append((i, " ".join(chained)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert {tuple(r) for r in got} == brute(rows, 80)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one_of_each(empty).count() == 0


@pytest.mark.parametrize("shape", ["chain", "star", "tree"])
def test_components(spark, shape):
    n = 300
    links = {"chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)],
             "tree": [(i, i // 3) for i in range(1, n + 1)]}[shape] + [(1001, 1000), (7, 7), (None, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(n + 1)} | {(1000, 1000), (1001, 1000)}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert {tuple(r) for r in minhash.near_duplicates(docs, 85).collect()} == brute(rows, 85)


@pytest.mark.parametrize("percent", [45, 60, 80, 85])
def test_pairs_just_above_the_threshold_are_found(spark, percent):
    """300 planted pairs for each threshold, of sets that are barely alike enough."""
    rnd = random.Random(percent)
    rows = []
    for k in range(300):
        n = rnd.randrange(60, 200)
        base = [f"b{k}w{rnd.random()}" for _ in range(n)]
        # A text and its beginning share n' of n shingles.
        keep = -(-(n - 4) * percent // 100) + 4
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:keep]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in range(300))
    assert found >= 299, found


def test_banding():
    assert minhash.banding(80) == minhash.banding(85) == minhash.banding(100) == (32, 5)
    for percent in range(7, 101):
        bands, rows = minhash.banding(percent)
        assert bands * rows <= 160 and (1 - (percent / 100) ** rows) ** bands <= 1.01e-5
    for percent in (0, 5):
        with pytest.raises(ValueError):
            minhash.banding(percent)
