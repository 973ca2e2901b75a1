"""Removed passages against reading the corpus in order with a set of seen windows."""

import random

import numpy as np

from feedfold.llm import substrings


def brute(rows, window=20):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = substrings.words_of(text)
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            t = tuple(words[i : i + window])
            if t in seen:
                keep[i : i + window] = [False] * window
            seen.add(t)
        kept = [w for w, k in zip(words, keep) if k]
        out[doc] = (len(words), len(words) - len(kept), b" ".join(kept).decode())
    return out


def found(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_words int, key string")
    return docs, substrings.remove_repeats(docs, **more).select("rest.doc_id", "n_words", "n_removed", "kept").collect()


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(300)}"
    passages = [[word() for _ in range(rnd.choice([12, 19, 20, 21, 50, 90]))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = []
        for _ in range(rnd.randrange(6)):
            text += [word() for _ in range(rnd.randrange(40))]
            p = rnd.choice(passages)
            cut = rnd.randrange(len(p))
            text += p if rnd.random() < 0.6 else p[:cut] if rnd.random() < 0.5 else p[cut:]
        rows.append((i * 3 % 151, rnd.choice([" ", "\n", "\t\x0b"]).join(text)))
    return rows


def test_passages_self_repeats_and_odd_rows(spark):
    rows = corpus(1) + [(900, None), (901, ""), (902, " \n"), (903, "Is onhe. " * 5_000), (904, "Is onhe. " * 30),
                        (905, "z " * 100_000), (906, "a b " * 10 + "c"), (None, "a b " * 10 + "c")]
    rnd = random.Random(2)
    rows += [(1000 + i, "the same long line of words that is under the limit " + " ".join(
        f"u{rnd.random()}" for _ in range(30))) for i in range(60)]
    _, got = found(spark, rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows)


def test_any_hot_grams_and_windows_give_the_same(spark, monkeypatch):
    rows = corpus(3)
    every = np.unique(np.concatenate([substrings.run_hashes(substrings.word_hashes(substrings.words_of(t)), 8)
                                      for _, t in rows]))
    for hot in (every[:0], every, every[::3]):
        monkeypatch.setattr(substrings, "hot_grams", lambda docs, h=hot: h)
        assert {r.doc_id: tuple(r)[1:] for r in found(spark, rows)[1]} == brute(rows)
    assert {r.doc_id: tuple(r)[1:] for r in found(spark, rows, window=9)[1]} == brute(rows, 9)


def test_anchors_over_the_bound_are_dealt_by_window(spark, monkeypatch):
    """One passage with other neighbours in every document: its edge windows are all different segments of few anchors."""
    rnd = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(21))
    near = lambda n: " ".join(f"n{rnd.randrange(40)}" for _ in range(n))
    rows = [(i, f"{near(9)} {passage} {near(9)}") for i in range(1_500)] + corpus(6)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    monkeypatch.setattr(substrings, "hot_grams", lambda docs: np.empty(0, np.uint64))
    for bound in (100, 2_000):
        monkeypatch.setattr(substrings, "SHARD_WORDS", bound)
        assert {r.doc_id: tuple(r)[1:] for r in found(spark, rows)[1]} == brute(rows)
    # The anchors that are marked are those over the bound.
    cuts = (substrings.segments(t, 20, np.empty(0, np.uint64)) for _, t in rows)
    segments = [s for c in cuts if c is not None for s in zip(*c)]
    distinct = {(a, c): n for a, c, _, n in segments}
    words = {}
    for (a, _), n in distinct.items():
        words[int(a)] = words.get(int(a), 0) + int(n) + 19
    assert max(words.values()) > 2_000


def test_judge_marks_large_anchors_once_across_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substrings, "SHARD_WORDS", 200)
    rows = sorted((key, seg, doc, 0, substrings._packed(np.zeros(1), np.array([doc]), np.array([3]))[0])
                  for key, n in ((1, 4), (2, 30), (3, 9), (4, 10), (5, 1)) for seg in range(n) for doc in (seg, 100 + seg))
    names = ["key", "seg", "id", "th", "span"]
    for size in (1, 2, 7, len(rows)):
        batches = [pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows[at : at + size]], pa.int32() if k == "th" else pa.int64())
                                               for i, k in enumerate(names)}) for at in range(0, len(rows), size)]
        out = pa.Table.from_batches(substrings._judge(iter(batches), 20)).to_pylist()
        kinds = lambda k: sorted(r["key"] for r in out if r["span"] >> 48 == k)
        assert kinds(substrings.LARGE) == [2, 4]  # 22 words a segment
        assert kinds(substrings.FIRST) == [1] * 4 + [2] * 30 + [3] * 9 + [4] * 10
        assert len(kinds(substrings.REMOVED)) == 54


def test_columns_with_names_of_its_own(spark):
    text = " ".join(f"v{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 7, "a", "b"), (2, text, 8, "c", "d"), (3, None, 9, None, None)],
                                 "doc_id long, text string, id int, `rest` string, `a.b` string")
    got = {r.rest.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert [got[i].rest.asDict() for i in (1, 2, 3)] == [r.asDict() for r in docs.orderBy("doc_id").collect()]
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 30, 0]


def test_repeated_rows_are_judged_alike(spark):
    text = " ".join(f"v{i}" for i in range(30))
    docs, got = found(spark, [(1, text), (1, text), (2, text)])
    assert sorted(tuple(r) for r in got) == [(1, 30, 0, text), (1, 30, 0, text), (2, 30, 30, "")]
    assert substrings.remove_repeats(docs.where("false")).count() == 0


def test_matching_statistics():
    rnd = random.Random(4)
    for _ in range(50):
        known = [[rnd.randrange(3) for _ in range(rnd.randrange(12))] for _ in range(4)]
        automaton = substrings.SuffixAutomaton()
        for k in known:
            automaton.add(k)
        runs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i, len(k) + 1)}
        asked = [rnd.randrange(3) for _ in range(25)]
        assert automaton.statistics(asked) == [
            max([n for n in range(1, e + 2) if tuple(asked[e + 1 - n : e + 1]) in runs], default=0) for e in range(25)]
