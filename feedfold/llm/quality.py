"""Quality of documents: a regularised quadratic discriminant over transformed document statistics.

Each class (quality 1 and 0) is a normal density over the statistics.  Its covariance is shrunk
towards the one that both share and towards a multiple of the identity; the Cholesky factor
is inverted once, and a score is the difference of two Mahalanobis log-densities and the
log odds of the classes, through the logistic function.  The moments are sums over all labelled rows, made in
the tasks, so nothing is sampled and the driver gets numbers of a fixed size.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import slices, tidy, written

STATISTICS = ("characters", "words", "word_length", "distinct_words", "top_word", "repeated_neighbours", "upper", "digits", "marks",
              "odd_marks", "bars", "spaces", "lines", "distinct_lines", "odd_ends", "ends", "vowels", "byte_entropy")
SHARED = 0.1  # weight of the covariance that both classes share
ROUND = 0.02  # weight of the multiple of the identity
LEAST_CLASS = 2  # labelled rows, below which a class is not learnt
STEEP = 0.25  # of the log-density difference: statistics depend on each other more than a normal density says

_UPPER, _DIGIT, _VOWEL = (np.frombuffer(x, np.uint8) for x in (bytes(range(65, 91)), bytes(range(48, 58)), b"aeiouAEIOU"))
_LETTER = np.concatenate([_UPPER, _UPPER + 32])
_END = np.frombuffer(b".,;:?", np.uint8)
_MARK = np.setdiff1d(np.arange(33, 127, dtype=np.uint8), np.concatenate([_LETTER, _DIGIT]))
_ODD = np.setdiff1d(_MARK, np.frombuffer(b".,;:?'\"()-", np.uint8))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``STATISTICS``; null is the empty text.

    Shares become log(share + 0.01), sizes log(1 + size).
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    of = np.frombuffer(raw, np.uint8)
    counts = np.bincount(of, minlength=256)
    size = max(1, len(raw))
    # The last byte of each word stands before white space.
    white = (of == 32) | ((of >= 9) & (of <= 13))
    ends = np.bincount(of[:-1][white[1:] & ~white[:-1]], minlength=256) if len(of) else counts
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / size
    shares = [
        len(seen) / n, (max(seen.values()) if seen else 0) / n, sum(map(operator.eq, words, words[1:])) / n,
        *(counts[some].sum() / size for some in (_UPPER, _DIGIT, _MARK, _ODD)), counts[124] / size, (size - sum(map(len, words))) / size,
        len(lines) / n, len(set(lines)) / max(1, len(lines)), ends[_ODD].sum() / n, ends[_END].sum() / n,
        counts[_VOWEL].sum() / max(1, counts[_LETTER].sum())]
    sizes = np.log1p([len(raw), len(words), sum(map(len, words)) / n])
    return [*sizes.tolist(), *np.log(np.array(shares) + 0.01).tolist(), float(-(p * np.log(p)).sum())]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = pa.array([statistics(t.as_py()) for t in batch.column("text")], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("rest"), x], ["rest", "x"])


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: rest (a struct of its other columns, whatever their names), x (``STATISTICS`` of the whole text).

    Null text counts as empty; repeated rows measure alike; an empty table gives no rows.
    """
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    docs = docs.select(rest.alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = StructType([docs.schema["rest"], StructField("x", ArrayType(DoubleType()))])
    return docs.mapInArrow(tidy(_measure), kinds)


def held_out(id_col: str) -> Column:
    """Whether a row is only tested on: crc32(id as text) mod 5 is 0; a row without id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of products of (1, x), by label."""
    d = len(STATISTICS) + 1
    sums = np.zeros((2, d, d))
    for batch in batches:
        x, label = _matrix(batch.column("x")), batch.column("label").to_numpy()
        for k in (0, 1):
            one = np.concatenate([np.ones((int((label == k).sum()), 1)), x[label == k]], axis=1)
            sums[k] += one.T @ one
    label, i, j = (a.ravel() for a in np.indices(sums.shape))
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums.ravel())],
                                     ["label", "i", "j", "value"])


class Model:
    """Means and inverted Cholesky factors of the two classes, and their log odds."""

    def __init__(self, sums: np.ndarray, shared: float = SHARED, round_: float = ROUND):
        n = sums[:, 0, 0]
        self.prior = float((n[1] + 1) / (n.sum() + 2))
        self.known = bool((n >= LEAST_CLASS).all())
        if not self.known:
            return
        mean = sums[:, 0, 1:] / n[:, None]
        covariance = sums[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        # In units of the spread of all labelled rows.
        weight = n / n.sum()
        centre = weight @ mean
        spread = np.sqrt(np.maximum((weight[:, None] * ((mean - centre) ** 2 + np.diagonal(covariance, axis1=1, axis2=2))).sum(0), 1e-6))
        self.centre, self.spread = centre, spread
        self.mean = (mean - centre) / spread
        covariance = covariance / spread[:, None] / spread[None, :]
        both = np.tensordot(weight, covariance, 1)
        self.inverse, self.log_density = [], []
        for k in (0, 1):
            s = (1 - shared) * covariance[k] + shared * both
            s = (1 - round_) * s + round_ * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.inverse.append(np.linalg.inv(factor))
            self.log_density.append(float(np.log(weight[k]) - np.log(np.diag(factor)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(x), self.prior)
        x = (x - self.centre) / self.spread
        away = [(((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        difference = (self.log_density[1] - away[1] / 2) - (self.log_density[0] - away[0] / 2)
        return 1 / (1 + np.exp(-np.clip(STEEP * difference, -500, 500)))


def fitted(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """A model from all labelled rows of ``measured`` that are not held out (``labels``: doc_id, quality).

    A document with both labels has the lesser, 0; labels that are null or neither 0 nor 1, and labels
    without a document, count for nothing. Repeated rows of a document each count. With fewer than
    two rows of a class, every score is the share of quality 1.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where(
        "id is not null and label in (0, 1)").where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    rows = rows.select(F.col("rest").getField(id_col).cast("long").alias("id"), "x").join(known, "id").select("label", "x")
    sums = np.zeros((2, len(STATISTICS) + 1, len(STATISTICS) + 1))
    added = rows.mapInArrow(tidy(_moments), "label int, i int, j int, value double").groupBy("label", "i", "j").agg(F.sum("value").alias("value"))
    for r in added.collect():  # twice the square of the number of statistics
        sums[r.label, r.i, r.j] = r.value
    return Model(sums)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(model.scores(_matrix(batch.column("x"))))], ["rest", "score"])


def score(rows: DataFrame, model: Model) -> DataFrame:
    """Per row of ``measured``: rest, score (0 to 1, higher: quality 1 likelier)."""
    kinds = StructType([rows.schema["rest"], StructField("score", DoubleType())])
    return rows.mapInArrow(tidy(partial(_score, model=model)), kinds)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all rows of ``docs`` by a model of its labelled ones; texts are read once."""
    rows = written(measured(docs, text_col), "quality-statistics")
    return score(rows, fitted(rows, labels, id_col))
