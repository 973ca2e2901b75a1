"""Retrieval against scoring every item, planted items, and odd rows."""

import random

import numpy as np
import pytest

from feedfold.llm import decontaminate
from feedfold.llm.decontaminate import Index, terms_of


def sentence(rnd, n, words=600):
    return " ".join(f"t{int(rnd.paretovariate(0.6)) % words}" for _ in range(n)).capitalize() + "."


def plain(rnd, n):
    return " ".join(f"t{rnd.randrange(5_000)}" for _ in range(n)).capitalize() + "."


def index_of(items):
    df = {}
    for _, text in items:
        for t in set(terms_of(text)):
            df[t] = df.get(t, 0) + 1
    return Index(items, df, len(items), decontaminate.PASSAGE / 2)


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5, 0.9])
def test_wand_finds_all_that_scoring_everything_finds(threshold):
    rnd = random.Random(1)
    items = [(i, " ".join(sentence(rnd, rnd.randrange(3, 40)) for _ in range(rnd.randrange(1, 5)))) for i in range(150)]
    index = index_of(items)
    for _ in range(120):
        n = rnd.randrange(0, 80)
        text = sentence(rnd, n) if rnd.random() < 0.5 else rnd.choice(items)[1] + sentence(rnd, n)
        terms = {index.number[t] for t in terms_of(text) if t in index.number}
        scores = [sum(w for t, w in own.items() if t in terms) for own in index.weights]
        want = {p for p, s in enumerate(scores) if s >= threshold}
        assert {p for p, _ in index.search(terms, threshold)} == want
        every = np.array([index.number.get(t, -1) for t in terms_of(text)], np.int64)
        likely = set(index.likely(every, threshold).tolist())
        for s in range(0, max(1, len(every) - 32), 32):
            own = {t for t in every[s : s + 64].tolist() if t >= 0}
            best = max(sum(w for t, w in weights.items() if t in own) for weights in index.weights)
            assert best < threshold or s in likely


def test_planted_items(spark, monkeypatch):
    rnd = random.Random(3)
    items = [(i, " ".join(plain(rnd, rnd.randrange(6, 30)) for _ in range(rnd.randrange(1, 4)))) for i in range(60)]
    items += [(100, " ".join(plain(rnd, 40) for _ in range(8))), (101, None), (102, " .. "), (103, items[3][1]),
              (104, "Short one"), (None, items[5][1])]
    clean = [(i, " ".join(plain(rnd, 25) for _ in range(rnd.randrange(0, 9)))) for i in range(120)]
    docs, want = list(clean), set()
    for k, (item, text) in enumerate(items[:61]):
        noise = [plain(rnd, rnd.randrange(0, 60)) for _ in range(2)]
        docs.append((1000 + k, f"{noise[0]} {text.upper() if k % 3 else text} {noise[1]}"))
        want.add((1000 + k, item))
        docs.append((2000 + k, f"{noise[0]} {' '.join(rnd.sample(text.split(), len(text.split())))}"))  # the words alone
    want |= {(1003, 103), (1005, None)}
    docs += [(5000, None), (5001, ""), (5002, "word " * 90_000), (None, items[7][1]), (5003, "so. Short one!")]
    want |= {(None, 7), (5003, 104)}
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, hits int, item_id string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for most in (50_000, 20):  # one index, or several
        monkeypatch.setattr(decontaminate, "MOST_ITEMS", most)
        got = decontaminate.matches(table, tests).select("rest.doc_id", "item_id").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        left = decontaminate.decontaminated(table, tests)
        assert left.columns == table.columns
        assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(
            str(i) for i, _ in docs if i not in {d for d, _ in want})


def test_short_answers_have_to_be_there(spark):
    rnd = random.Random(5)
    ask = lambda: plain(rnd, 20)[:-1] + "? "
    q, named, single, long = ask(), "Is it Lyon or Paris or Rome that " + ask(), plain(rnd, 20), plain(rnd, 20) + " " + plain(rnd, 6)
    items = [(1, q + "Paris."), (2, named + "Paris"), (3, single), (4, long), (5, ask() + "In the old town.")]
    four = items[4][1]
    docs = {
        "question": q, "both": q + "Paris.", "near": f"{q} I think it is paris, yes.", "far": q + plain(rnd, 300) + " Paris.",
        "named": named, "named twice": named + plain(rnd, 3) + " " + named, "named and answered": named + "Paris!",
        "single": single, "long": long, "long question": long[: long.index(".") + 1],
        "four": four, "four not whole": four.replace(" town", ""), "four not in order": four.replace("In the old town", "Old town in the")}
    noise = plain(rnd, 90)
    table = spark.createDataFrame([(k, f"{before}{v}{after}") for k, v in docs.items() for before, after in (("", ""), (noise + " ", " " + noise))],
                                  "doc_id string, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(table, tests).select("rest.doc_id", "item_id", "answer_overlap").collect()
    assert sorted(tuple(r) for r in got) == sorted(
        [("both", 1, 1.0), ("near", 1, 1.0), ("named and answered", 2, 1.0), ("single", 3, 1.0), ("long", 4, 1.0), ("four", 5, 1.0)] * 2)


def test_empty_tables(spark):
    none, some = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([], [(1, "a b c d e f g")]))
    items = some.toDF("item_id", "text")
    assert decontaminate.matches(none, items).count() == 0
    assert decontaminate.matches(some, items.where("false")).count() == 0
    assert decontaminate.decontaminated(some, items.where("false")).count() == 1
    assert decontaminate.decontaminated(some, items).count() == 0
