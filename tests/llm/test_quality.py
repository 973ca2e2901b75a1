"""The discriminant against densities written out, and against held-out labels."""

import os
import zlib

import numpy as np
import pytest

from feedfold.llm import catalog, quality

SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    """Each statistic by counting characters and words one by one."""
    raw = (text or "").encode()
    words, size = raw.split(), max(1, len(raw))
    n = max(1, len(words))
    marks = [c for c in raw if 33 <= c < 127 and not chr(c).isalnum()]
    odd = set(b"!#$%&*+/<=>@[\\]^_`{|}~")
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = [c for c in raw if chr(c).isascii() and chr(c).isalpha()]
    last = [w[-1] for w in raw.split()]
    if raw and not raw[-1:].isspace():
        last = last[:-1]  # an end is a byte before white space
    shares = [len(set(words)) / n, max((words.count(w) for w in set(words)), default=0) / n,
              sum(a == b for a, b in zip(words, words[1:])) / n, sum(65 <= c <= 90 for c in raw) / size, sum(48 <= c <= 57 for c in raw) / size,
              len(marks) / size, sum(c in odd for c in marks) / size, raw.count(b"|") / size, (size - sum(map(len, words))) / size,
              len(lines) / n, len(set(lines)) / max(1, len(lines)), sum(c in odd for c in last) / n, sum(c in b".,;:?" for c in last) / n,
              sum(c in b"aeiouAEIOU" for c in raw) / max(1, len(letters))]
    p = [raw.count(bytes([c])) / size for c in set(raw)]
    return [np.log1p(len(raw)), np.log1p(len(words)), np.log1p(sum(map(len, words)) / n), *(np.log(s + 0.01) for s in shares),
            -sum(x * np.log(x) for x in p)]


TEXTS = [None, "", " ", "\n\n", "A", "one two two two.", "x! y$ | z\n\nx! y$ | z\n", "\u00c4rger \u4e16\u754c 12:30", "ab " * 50_000,
         "THE!! END!!\tof\x0bit\r\n  ", "a" * 300_000]


def test_statistics_of_odd_texts():
    for text in TEXTS:
        got = quality.statistics(text)
        assert len(got) == len(quality.STATISTICS) and np.isfinite(got).all()
        assert np.allclose(got, plain_statistics(text)), text and text[:30]


def test_scores_are_differences_of_log_densities(spark):
    rnd = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    mix = rnd.normal(size=(2, d, d))
    x = [rnd.normal(size=(n, d)) @ mix[k] + k for k, n in ((0, 60), (1, 90))]
    sums = np.stack([(one := np.concatenate([np.ones((len(v), 1)), v], axis=1)).T @ one for v in x])
    got = quality.Model(sums).scores(np.concatenate(x))
    both = np.concatenate(x)
    centre, spread = both.mean(0), both.std(0)
    z = [(v - centre) / spread for v in x]
    cov = [np.cov(v.T, bias=True) for v in z]
    pool = (60 * cov[0] + 90 * cov[1]) / 150
    log = []
    for k, n in ((0, 60), (1, 90)):
        s = (1 - quality.SHARED) * cov[k] + quality.SHARED * pool
        s = (1 - quality.ROUND) * s + quality.ROUND * np.trace(s) / d * np.eye(d)
        off = np.concatenate(z) - z[k].mean(0)
        log.append(np.log(n / 150) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(s), off))
    assert np.allclose(got, 1 / (1 + np.exp(-quality.STEEP * (log[1] - log[0]))), atol=1e-9)


def test_moments_are_those_of_the_labelled_rows(spark):
    docs = [(i, f"word{i} and {'!' * (i % 3)} more") for i in range(40)] + [(None, "none"), (7, "again 7"), (3, None)]
    labels = [(i, i % 2, 0) for i in range(0, 40, 3)] + [(6, 1, 0), (9, None, 0), (12, 5, 0), (None, 1, 0), (999, 1, 1)]
    rows = quality.measured(spark.createDataFrame(docs, "doc_id long, text string"))
    model = quality.fitted(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    known = {}
    for i, q, _ in labels:
        if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            known[i] = min(q, known.get(i, 1))
    x = [np.array([quality.statistics(t) for i, t in docs if known.get(i) == k]) for k in (0, 1)]
    sums = np.stack([(one := np.concatenate([np.ones((len(v), 1)), v], axis=1)).T @ one for v in x])
    want = quality.Model(sums)
    every = np.array([quality.statistics(t) for _, t in docs])
    assert np.allclose(model.scores(every), want.scores(every))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "r") for i, t in enumerate(TEXTS)], "doc_id long, text string, score double, rest string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, none).collect()
    assert len(got) == len(TEXTS) and {r.score for r in got} == {0.5} and got[0].rest.rest == "r"
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {0 < r.score < 1 for r in quality.scored(docs, one).collect()} == {True}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, both).collect())
    assert quality.scored(docs.where("false"), both).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not there")
def test_held_out_labels(spark):
    got = {r.doc_id: r for r in catalog.QUERIES["op12_quality"](spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    tested = [i for i in labels if got[i].held_out]
    right = [got[i].predicted == labels[i] for i in tested]
    assert len(tested) > 50 and sum(right) / len(right) >= 0.97
