"""Links of vectors against all pairs."""

import numpy as np
import pytest

from feedfold.llm import embeddings


def brute(rows, least=0.98):
    unique = {(i, tuple(v), label) for i, v, label in rows if i is not None and label is not None and v
              and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unique = [(i, np.array(v, np.float64), label) for i, v, label in sorted(unique)]
    n, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v, label) in enumerate(unique):
        for j, w, other in unique[a + 1 :]:
            if label != other or len(v) != len(w) or i == j:
                continue
            x, y = v / np.abs(v).max(), w / np.abs(w).max()
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                n[i] += 1
                n[j] += 1
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted(map(str, ((i, n[i] if i is not None else 0, find(i) if i is not None else None,
                             find(i) == i if i is not None else None) for i, *_ in rows)))


def clouds(seed, groups=14, dim=6, noise=0.09):
    rnd = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = rnd.standard_normal(dim)
        for _ in range(rnd.integers(1, 30)):
            rows.append((len(rows) * 3, [float(x) for x in base + noise * rnd.standard_normal(dim)], g % 2))
    return rows


@pytest.mark.parametrize("single,tile", [(10_000, 1024), (4, 1024), (4, 5)])
def test_cells_and_tiles(spark, monkeypatch, single, tile):
    monkeypatch.setattr(embeddings, "SINGLE", single)
    monkeypatch.setattr(embeddings, "TILE", tile)
    whole = embeddings.math.sqrt
    monkeypatch.setattr(embeddings.math, "sqrt", lambda x: 6 * whole(x) if x > 1 else whole(x))  # many pivots
    rows = clouds(1)
    rows += [(5000 + k, rows[4][1], rows[4][2]) for k in range(6)]  # equal vectors
    rows += [(6000, [2 * x for x in rows[4][1]], rows[4][2]), (6001, [1e-200 * x for x in rows[4][1]], rows[4][2]),
             (6002, [1e200 * x for x in rows[4][1]], rows[4][2]), (6003, rows[4][1], None), (None, rows[4][1], 0),
             (6004, None, 0), (6005, [], 0), (6006, [0.0] * 6, 0), (6007, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0),
             (6008, [float("nan")] * 6, 0), (6009, [float("inf")] + [0.0] * 5, 0), (6010, [1.0, 0.0], 0), (6011, [1.0, 0.01], 0),
             (6012, rows[8][1], rows[8][2]), (6012, rows[8][1], rows[8][2]), (3, rows[50][1], rows[50][2])]
    table = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows],
                                  "vec_id long, embedding array<double>, label int, n_links int, key int")
    got = [tuple(r) for r in embeddings.near_vectors(table).collect()]
    assert sorted(map(str, got)) == brute(rows)


def test_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_scaling_is_exact(spark, monkeypatch):
    """Vectors are only multiplied by powers of two, also those whose largest number has an odd exponent."""
    seen = []
    pivots = embeddings.pivots
    monkeypatch.setattr(embeddings, "pivots", lambda vectors: (seen.extend(vectors.collect()), pivots(vectors))[1])
    given = [[3.1, 2.7, 0.3], [1.55, 1.35, 0.15], [1e-300, 3e-301, 0.0], [7e300, -1e299, 5.0], [0.1, 0.2, 0.3], [-9.0, 1.0, 2.0]]
    rows = [(i, v, "a") for i, v in enumerate(given)]
    embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    made = {r.node: r.v for r in seen}
    assert made[0] == [1.55, 1.35, 0.15] and len(made) == 5  # the first two are one vector
    for i, v in made.items():
        factors = {np.frexp(a)[0] == np.frexp(b)[0] for a, b in zip(v, given[i])}
        assert factors == {True} and 1 <= max(map(abs, v)) < 2
