"""Benchmark decontamination: a BM25 inverted index of the test items, asked with every passage of every document.

Items are the documents of the index and passages the queries.  An item's score is divided
by what it scores itself, so one threshold fits all.  Passages that cannot reach it by the
greatest impacts in ranges of items are passed over; block-max WAND finds all
items for the others.  An item counts once its question and its answer are both found near
the passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import slices, tidy, words_of

PASSAGE, STRIDE = 64, 32
K1, B = 1.2, 0.75
BLOCK = 8  # postings of a block
RANGES = 32
GRAM, LEAST_ANSWER = 3, 5
MOST_ITEMS = 50_000  # of one index; more items make more indexes, each asked with all passages
MARKS = b".,;:!?()[]{}\"'*_-"


def terms_of(text: str | None) -> list[bytes]:
    return [t for w in words_of(text, lower=True) if (t := w.strip(MARKS))]


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The answer is what follows the last sentence end that leaves it five words; without one, the last that leaves it
    any words; a single sentence is both as a whole."""
    short = None
    for end in reversed(list(re.finditer(r"[.?!:]\s+|\n", text or ""))):
        question, answer = terms_of(text[: end.end()]), terms_of(text[end.end() :])
        if question and len(answer) >= LEAST_ANSWER:
            return question, answer
        if question and answer:
            short = short or (question, answer)
    return short or (terms_of(text), terms_of(text))


def _grams(terms: list) -> set[tuple]:
    n = min(GRAM, len(terms))
    return {tuple(terms[i : i + n]) for i in range(len(terms) - n + 1)} if n else set()


def _places(terms: list, run: list, first: int = 0, last: int | None = None) -> list[tuple]:
    """The terms before and after each place from ``first`` to ``last`` where the run is, in order and whole; None at an end."""
    n, last = len(run), len(terms) if last is None else last
    return [(terms[i - 1] if i else None, terms[i + n] if i + n < len(terms) else None)
            for i in range(first, last - n + 1) if terms[i : i + n] == run]


class Index:
    """Postings (part of an item, impact) of each term in blocks with their greatest impact."""

    def __init__(self, items: list[tuple[int, str]], df: dict[bytes, int], n: int, mean: float):
        self.ids, self.sides, self.short, self.lengths, parts = [], [], [], [], []
        self.number: dict[bytes, int] = {}
        for item, text in items:
            terms = [self.number.setdefault(t, len(self.number)) for t in terms_of(text)]
            if not terms:
                continue
            sides = [[self.number[t] for t in side] for side in question_and_answer(text)]
            parts += [(len(self.ids), terms[s : s + PASSAGE]) for s in range(0, len(terms), PASSAGE)]
            self.ids.append(item), self.sides.append([_grams(s) for s in sides]), self.lengths.append(len(terms))
            # A short answer, and the neighbours it has where the question itself names it.
            question, answer = sides
            short = len(answer) < LEAST_ANSWER and answer != question
            self.short.append((answer, _places(question, answer)) if short else None)
        idf = np.array([math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in self.number])
        self.item_of = np.array([i for i, _ in parts], np.int64)
        self.weights: list[dict[int, float]] = []
        for _, terms in parts:
            own = {t: idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(terms) / mean)) for t, c in Counter(terms).items()}
            whole = sum(own.values())
            self.weights.append({t: w / whole for t, w in own.items()})
        self.lists: list[list[tuple[int, float]]] = [[] for _ in self.number]
        for part, own in enumerate(self.weights):
            for t, w in own.items():
                self.lists[t].append((part, w))
        self.greatest = [max(w for _, w in postings) for postings in self.lists]
        self.blocks = [[(p[min(s + BLOCK, len(p)) - 1][0], max(w for _, w in p[s : s + BLOCK])) for s in range(0, len(p), BLOCK)]
                       for p in self.lists]
        # Greatest impacts in ranges of items; the last row is for terms that no item has.
        self.ranges = np.zeros((len(self.number) + 1, RANGES), np.float32)
        for t, postings in enumerate(self.lists):
            for part, w in postings:
                r = part * RANGES // len(parts)
                self.ranges[t, r] = max(self.ranges[t, r], w)

    def search(self, terms: set[int], threshold: float) -> list[tuple[int, float]]:
        """All parts that score ``threshold`` or more for a set of terms, by block-max WAND."""
        least = threshold - 1e-6
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]  # part, position, term
        found, end = [], len(self.weights)
        while True:
            cursors.sort()
            total, pivot = 0.0, None
            for i, (part, _, t) in enumerate(cursors):
                total += self.greatest[t]
                if total >= least:
                    pivot = i
                    break
            if pivot is None or (part := cursors[pivot][0]) >= end:
                return found
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            total, ahead = 0.0, end  # what the blocks that hold the pivot allow, and where the first of them ends
            for c in cursors[: pivot + 1]:
                blocks, b = self.blocks[c[2]], c[1] // BLOCK
                while b < len(blocks) and blocks[b][0] < part:
                    b += 1
                if b < len(blocks):
                    total += blocks[b][1]
                    ahead = min(ahead, blocks[b][0])
            if total >= least:
                score = sum(self.weights[part].get(t, 0.0) for t in terms)
                if score >= threshold:
                    found.append((part, score))
                target = part + 1
            else:
                target = ahead + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, part + 1)
            for c in cursors[: pivot + 1]:
                postings, at = self.lists[c[2]], c[1]
                while at < len(postings) and postings[at][0] < target:
                    at += 1
                c[0], c[1] = (postings[at][0] if at < len(postings) else end), at

    def likely(self, terms: np.ndarray, threshold: float) -> np.ndarray:
        """First words of the passages of a text that could reach the threshold in some range of items."""
        starts = np.arange(0, max(1, len(terms) - (PASSAGE - STRIDE)), STRIDE)
        padded = np.concatenate([terms.astype(np.int32), np.full(PASSAGE, -1, np.int32)])
        own = np.sort(np.lib.stride_tricks.sliding_window_view(padded, PASSAGE)[::STRIDE][: len(starts)], axis=1)
        own[:, 1:][own[:, 1:] == own[:, :-1]] = -1  # a term counts once; -1 is the row of zeros
        best = np.empty(len(starts), np.float32)
        for i in range(0, len(starts), 256):
            best[i : i + 256] = self.ranges[own[i : i + 256]].sum(axis=1).max(axis=1)
        return starts[best >= threshold - 1e-4]


class _Numbers(dict):
    """Term numbers of raw words: -1 if no item has the term, -2 if there is none; remembers a bounded number of words."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known

    def __missing__(self, word: bytes) -> int:
        term = word.strip(MARKS)
        number = self.known.get(term, -1) if term else -2
        if len(self) < 500_000:
            self[word] = number
        return number


def _hits(text: str | None, index: Index, numbers: _Numbers, threshold: float, overlap: float) -> list[dict]:
    words = words_of(text, lower=True)
    terms = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    terms = terms[terms != -2]
    best: dict[int, tuple] = {}
    for start in index.likely(terms, threshold):
        stop = min(start + PASSAGE, len(terms))
        for part, score in index.search({t for t in terms[start:stop].tolist() if t >= 0}, threshold):
            item = int(index.item_of[part])
            first, last = max(0, start - index.lengths[item]), min(len(terms), stop + index.lengths[item])
            around = terms[first:last].tolist()
            shares = []
            for side in index.sides[item]:
                n = len(next(iter(side)))
                there = {tuple(around[i : i + n]) for i in range(len(around) - n + 1)}
                shares.append(len(side & there) / len(side))
            if index.short[item]:
                (answer, own), edge = index.short[item], min(first, 1)
                places = _places(terms[first - edge : last + 1].tolist(), answer, edge, edge + last - first)
                shares[1] = float(any(not any(a in (None, before) and b in (None, after) for a, b in own) for before, after in places))
            best[item] = max(best.get(item, (-1.0, 0.0, 0.0, 0.0)), (min(shares), score, *shares))
    return [{"item_id": index.ids[i], "score": s, "question_overlap": q, "answer_overlap": a}
            for i, (least, s, q, a) in sorted(best.items()) if least >= overlap]


HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def _search(batches: Iterator[pa.RecordBatch], index: Index, threshold: float, overlap: float) -> Iterator[pa.RecordBatch]:
    numbers = _Numbers(index.number)
    hit = pa.struct([("item_id", pa.int64()), *((k, pa.float64()) for k in ("score", "question_overlap", "answer_overlap"))])
    for batch in slices(batches):
        hits = [_hits(text.as_py(), index, numbers, threshold, overlap) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("text"), pa.array(hits, pa.list_(hit))],
                                         ["rest", "text", "hits"])


def _df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, len(t), term) for i, text in zip(*(c.to_pylist() for c in batch.columns))
                 for t in [terms_of(text)] for term in set(t)]
        ids, sizes, terms = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.binary())],
                                         ["id", "size", "term"])


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes of at most MOST_ITEMS items each, with the statistics of all of them; one is in memory at a time."""
    items = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        "text is not null").distinct()
    n = items.count()
    spread = max(1, -(-n // (MOST_ITEMS * 4 // 5)))
    terms = items.mapInArrow(_df, "id long, size long, term binary")
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    mean = PASSAGE / 2.0  # a fixed length to compare with, so that scores do not hang on the number of items
    shard = F.pmod(F.xxhash64("id", "text"), F.lit(spread))
    for k in range(spread if n else 0):
        own = items.where(shard == k)
        rows = [(r.id, r.text) for r in own.orderBy("id", "text").collect()]
        used = own.mapInArrow(_df, "id long, size long, term binary").select("term").distinct()
        yield Index(rows, {bytes(r.term): r.df for r in df.join(used, "term").collect()}, n, mean)


def _with_rest(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.struct("*").alias("rest"), F.col(text_col).cast("string").alias("text"))


def _asked(docs: DataFrame, index: Index, threshold: float, overlap: float) -> DataFrame:
    schema = StructType([*docs.schema.fields, *_parse_datatype_string(f"hits {HITS}").fields])
    return docs.mapInArrow(tidy(lambda it: _search(it, index, threshold, overlap)), schema)


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.6, text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs`` and item found in it: rest (a struct of the columns), item_id, score,
    question_overlap, answer_overlap.

    Passages of 64 terms begin every 32 terms of the whole text.  A passage retrieves each item
    that scores ``threshold`` of its own best score or more; items longer than a passage are indexed in
    parts.  It is a match if at least ``overlap`` of the three-term runs of its question, and of its
    answer, are around the passage.  An answer of fewer than five terms has to be there whole and in order, besides where
    the question names it; its overlap is 0 or 1.  Terms are lower-case words without punctuation at their ends.

    Null, empty and term-less texts and items match nothing. Repeated rows match alike; repeated items count once,
    different items of one id each. Empty tables give no rows.
    """
    docs, out = _with_rest(docs, text_col), None
    for index in indexes(items):
        found = _asked(docs, index, threshold, overlap).select("rest", F.explode("hits").alias("hit")).select("rest", "hit.*")
        out = found if out is None else out.unionByName(found)
    return docs.where("false").select("rest", F.expr(f"explode(cast(null as {HITS}))").alias("hit")).select("rest", "hit.*") \
        if out is None else out


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.6,
                   text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which an item is found."""
    left = _with_rest(docs, text_col)
    for index in indexes(items):
        left = _asked(left, index, threshold, overlap).where(F.size("hits") == 0).select("rest", "text")
    return left.select("rest.*")
