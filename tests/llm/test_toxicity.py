"""The network: gradients against differences, held-out accuracy, windows and odd rows."""

import os
import random
import zlib

import numpy as np
import pytest
import xxhash

from feedfold.llm import catalog, toxicity
from feedfold.llm.common import words_of


def test_gradients(monkeypatch):
    rnd = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in toxicity.new_model(1).items()}
    gates = rnd.standard_normal((5, 6 * toxicity.HIDDEN))
    at = rnd.integers(-1, 5, (3, 7))
    at[0] = -1
    want = rnd.standard_normal(3)
    monkeypatch.setattr(np, "float32", np.float64)  # differences need the digits
    forward = lambda g, **more: toxicity.forward(model, np.concatenate([g, model["b"][None]]), at, **more)
    _, kept = forward(gates, keep=True)
    grads, d_gates = toxicity.backward(model, at, want, kept, 5)
    for name, g in [*grads.items(), ("gates", d_gates)]:
        table = gates if name == "gates" else model[name]
        for _ in range(6):
            place = tuple(rnd.integers(0, n) for n in table.shape)
            was, sides = table[place], []
            for by in (1e-5, -1e-5):
                table[place] = was + by
                moved = gates + by * (np.arange(gates.shape[1]) == place[0]) if name == "b" else gates  # b is in all gates
                sides.append(float(want @ forward(moved)))
            table[place] = was
            assert g[place] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6), name


@pytest.mark.parametrize("n", [0, 1, 47, 48, 49, 80, 81, 500])
def test_windows_cover_every_word_and_overlap(n):
    at = toxicity.windows(n)
    assert set(at[at >= 0]) == set(range(n))
    assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(at, at[1:]))


def corpus(n, seed):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"{rnd.choice('bdgklm')}{rnd.choice('aeiou')}{rnd.choice('nrst')}{rnd.randrange(30)}" for _ in range(rnd.randrange(5, 300))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(["vilefool", f"grobzak{rnd.choice(['en', 'er', 'um'])}"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus(900, 1)
    odd = [(None, "vilefool vilefool"), (5000, None), (5001, ""), (5002, " \n"), (5003, "bar " * 90_000 + "grobzaken grobzaken"),
           (5004, "grobzakels vilefool"), (5004, "grobzakels vilefool")]
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in rows + odd], "doc_id long, text string, rest string, score int")
    table = spark.createDataFrame(labels + [(None, 1, 1), (7, None, None), (9, 0, 9)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(docs, table)
    got = [(r.rest.doc_id, r.score, r.rest.text) for r in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for _, s, _ in got)
    truth = dict((i, t) for i, _, t in labels)
    import zlib
    tested = [(s >= 0.5) == truth[i] for i, s, _ in got if i in truth and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(tested) > 100 and np.mean(tested) > 0.97
    scores = {(i, t): s for i, s, t in got}
    assert scores[5003, odd[4][1]] >= 0.5 and scores[None, odd[0][1]] >= 0.5
    assert scores[5000, None] == scores[5001, ""] == scores[5002, " \n"] < 0.5
    left = toxicity.reject(docs, model)
    assert left.columns == docs.columns and left.where("doc_id in (5003, 5004) or doc_id is null").count() == 0


def test_held_out_rows_and_other_columns_do_not_count(spark):
    rows, labels = corpus(120, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    flipped = table.selectExpr("doc_id", "quality", "if(crc32(string(doc_id)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = toxicity.fitted(docs, table), toxicity.fitted(docs, flipped)
    assert all((a[k] == b[k]).all() for k in a)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.reject(docs, toxicity.fitted(docs, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="tables are not there")
def test_given_tables(spark):
    got = catalog.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    right = [r.predicted == r.toxic for r in got.where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()]
    assert np.mean(right) > 0.95


def plain_score(model, text):
    """The score of a text word by word: a loop for each window, direction, word and gate."""
    words = words_of(text, lower=True)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    m, n = {k: v.astype(np.float64) for k, v in model.items()}, toxicity.HIDDEN

    def gates_of(word):
        if word is None:
            return m["b"]
        bare = word.strip(toxicity.MARKS) or word
        ids, buckets, starts, counts = toxicity.word_features([word])
        assert ids[0] == xxhash.xxh3_64_intdigest(bare) % toxicity.BUCKETS
        chars = [m["char"][b] for b in buckets[starts[0] : starts[0] + counts[0]]]
        mean = sum(chars) / len(chars) if chars else np.zeros(toxicity.WIDTH)
        return np.concatenate([m["word"][ids[0]], mean]) @ m["W"] + m["b"]

    logits = []
    for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
        window = words[start : start + toxicity.WINDOW]
        window = window + [None] * (toxicity.WINDOW - len(window))
        sides = []
        for d, order in enumerate((range(len(window)), reversed(range(len(window))))):
            h, states = np.zeros(n), {}
            for i in order:
                x, u = gates_of(window[i])[3 * n * d : 3 * n * (d + 1)], h @ m["U"][d]
                z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
                h = states[i] = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
            sides.append(states)
        states = [np.concatenate([side[i] for side in sides]) for i, w in enumerate(window) if w is not None]
        pooled = np.zeros(2 * n)
        if states:
            weight = np.exp([np.tanh(s @ m["A"] + m["a"]) @ m["v"] for s in states])
            pooled = sum(w * s for w, s in zip(weight / weight.sum(), states))
        logits.append(pooled @ m["o"] + m["c"][0])
    return sigmoid(max(logits))


def test_scores_equal_a_plain_loop():
    """Embeddings, both directions, attention, windows and their maximum, without any array of several words."""
    rnd = random.Random(8)
    model = {k: v * 3 for k, v in toxicity.new_model(5).items()}
    word = lambda: "".join(rnd.choice("abcd\u00e9T") for _ in range(rnd.randrange(1, 9))) + rnd.choice(["", "", "!", "..."])
    texts = [None, "", " ", "a", "!!", *(" ".join(word() for _ in range(n)) for n in (3, 47, 48, 49, 80, 81, 130))]
    batch = toxicity.Batch(texts)
    got = 1 / (1 + np.exp(-batch.worst(batch.logits(model, toxicity.word_features(batch.words))).astype(np.float64)))
    want = [plain_score(model, t) for t in texts]
    assert max(want) - min(want) > 0.2 and np.allclose(got, want, atol=2e-5)


def test_the_sample(spark, monkeypatch):
    """Whole texts, however long; ties of labels and texts; the two bounds."""
    long = "very long " * 5_000
    docs = [(1, long), (2, "b"), (2, "bb"), (2, "ba"), (3, None), (4, "d"), (None, "e"), (6, "f"), (7, "g" * 100), (8, "h" * 100)]
    labels = [(1, 1), (2, 0), (2, 1), (2, 0), (3, 1), (4, 0), (None, 1), (6, None), (6, 7), (7, 0), (8, 0), (99, 1)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, toxic int")
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    want = {1: (long, 1), 2: ("ba", 1), 4: ("d", 0), 7: ("g" * 100, 0), 8: ("h" * 100, 0)}
    want = [want[i] for i in want if zlib.crc32(str(i).encode()) % 5]
    assert list(zip(*toxicity.labelled_sample(docs, table))) == want
    assert all(sum(label == c for label in toxicity.labelled_sample(docs, table, 1)[1]) == 1 for c in (0, 1))
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 150)
    texts, _ = toxicity.labelled_sample(docs, table)
    assert "ba" in texts and long not in texts and len([t for t in texts if len(t) == 100]) <= 1
