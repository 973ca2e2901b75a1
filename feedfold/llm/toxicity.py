"""Toxic documents: a bidirectional gated recurrent network with attention pooling over words and their characters.

A word's input is the embedding of its hash beside the mean embedding of its hashed
character runs.  A document's score is that of its worst window.  The network is trained in
numpy on a bounded sample of labelled rows; tasks then score whole texts, all windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidy, words_of

WINDOW, STRIDE = 48, 32
BUCKETS, WIDTH, HIDDEN, ATTEND = 2**14, 8, 8, 8
CHUNK = 16_384  # words whose features are made at once
GRAMS = (3, 4, 5)
MARKS = b".,;:!?()[]{}\"'*_-"
SAMPLE_PER_CLASS, SAMPLE_CHARS, EPOCHS, STEP, DROPPED = 2_000, 16_000_000, 8, 0.02, 0.5


def _chunk_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bare = [w.strip(MARKS) or w for w in words]
    ids = np.fromiter((xxhash.xxh3_64_intdigest(w) % BUCKETS for w in bare), np.int32, len(bare))
    flat = np.frombuffer(b"\0" + b"\0".join(bare) + b"\0", np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, bare), np.int64, len(bare))
    owner = np.repeat(np.arange(len(bare), dtype=np.int32), lengths + 1)
    ends = np.cumsum(lengths + 1)  # of each word's bytes, where its end mark is
    buckets, owners = [], []
    for n in GRAMS:  # runs that lie in a word with its two ends
        begins = np.arange(len(owner))
        begins = begins[begins + n <= ends[owner] + 1]
        h = np.full(len(begins), n, np.uint32)
        for j in range(n):
            h = (h ^ flat[begins + j]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        buckets.append((h * np.uint32(0x9E3779B1) >> np.uint32(18)).astype(np.int32))
        owners.append(owner[begins])
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    return ids, buckets[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(bare))


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets; then character buckets, where each word's begin in them, and how many each has."""
    parts = [_chunk_features(words[i : i + CHUNK]) for i in range(0, len(words), CHUNK)] or [_chunk_features([])]
    ids, buckets, counts = (np.concatenate(p) for p in zip(*parts))
    return ids, buckets, np.cumsum(counts) - counts, counts


def _sums(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts), values.shape[1]), np.float32)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, starts[some], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_model(seed: int = 3) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(seed)
    shapes = {"word": (BUCKETS, WIDTH), "char": (BUCKETS, WIDTH), "W": (2 * WIDTH, 6 * HIDDEN), "b": (6 * HIDDEN,),
              "U": (2, HIDDEN, 3 * HIDDEN), "A": (2 * HIDDEN, ATTEND), "a": (ATTEND,), "v": (ATTEND,), "o": (2 * HIDDEN,),
              "c": (1,)}
    small = {"word": 0.05, "char": 0.05, "b": 0.0, "a": 0.0, "c": 0.0}
    return {k: (rnd.standard_normal(s) * small.get(k, 0.3)).astype(np.float32) for k, s in shapes.items()}


def inputs(model: dict, features) -> np.ndarray:
    ids, buckets, starts, counts = features
    chars = _sums(model["char"][buckets], starts, counts) / np.maximum(counts, 1)[:, None].astype(np.float32)
    return np.concatenate([model["word"][ids], chars], axis=1)


def word_gates(model: dict, features) -> np.ndarray:
    """The words' share of all gates, and a last row for no word; so many words at a time as bounds the memory."""
    ids, buckets, starts, counts = features
    out = np.empty((len(ids) + 1, 6 * HIDDEN), np.float32)
    for s in range(0, len(ids), CHUNK):
        e = min(s + CHUNK, len(ids))
        first, last = starts[s], starts[e - 1] + counts[e - 1]
        own = ids[s:e], buckets[first:last], starts[s:e] - first, counts[s:e]
        out[s:e] = inputs(model, own) @ model["W"] + model["b"]
    out[-1] = model["b"]
    return out


def forward(model: dict, gates: np.ndarray, at: np.ndarray, keep: bool = False):
    """Logits of windows ``at`` (places in ``gates``; -1, the last row, is no word).  ``gates``: the words' share of all gates."""
    b, t, n = *at.shape, HIDDEN
    real = at >= 0
    gates = gates.reshape(-1, 2, 3 * n)
    sides = (at, at[:, ::-1])
    h = np.zeros((2, b, n), np.float32)
    states, cache = np.empty((2, t, b, n), np.float32), []
    for step in range(t):
        x = np.stack([gates[side[:, step], d] for d, side in enumerate(sides)])
        u = np.matmul(h, model["U"])
        zr = _sigmoid(x[:, :, : 2 * n] + u[:, :, : 2 * n])
        z, r = zr[:, :, :n], zr[:, :, n:]
        new = np.tanh(x[:, :, 2 * n :] + r * u[:, :, 2 * n :])
        if keep:
            cache.append((h, z, r, u[:, :, 2 * n :], new))
        h = new + z * (h - new)
        states[:, step] = h
    both = np.concatenate([states[0], states[1, ::-1]], axis=2).transpose(1, 0, 2)  # b, t, 2n
    energy = np.tanh(both @ model["A"] + model["a"])
    score = np.where(real, energy @ model["v"], np.float32(-1e9))
    weight = np.exp(score - score.max(axis=1, keepdims=True)) * real
    weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
    pooled = np.einsum("bt,btn->bn", weight, both)
    logit = pooled @ model["o"] + model["c"][0]
    return (logit, (cache, both, energy, weight, pooled)) if keep else logit


def backward(model: dict, at: np.ndarray, d_logit: np.ndarray, kept, words: int) -> tuple[dict, np.ndarray]:
    """Gradients of all but the embeddings, and of the words' share of the gates (``words`` rows)."""
    cache, both, energy, weight, pooled = kept
    b, t, n = *at.shape, HIDDEN
    g = {"o": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * model["o"]
    d_weight = np.einsum("bn,btn->bt", d_pooled, both)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    d_energy = d_score[:, :, None] * model["v"] * (1 - energy**2)
    g["v"] = np.einsum("bt,btk->k", d_score, energy)
    g["A"], g["a"] = np.einsum("btn,btk->nk", both, d_energy), d_energy.sum(axis=(0, 1))
    d_both = weight[:, :, None] * d_pooled[:, None] + d_energy @ model["A"].T
    d_states = np.stack([d_both[:, :, :n].transpose(1, 0, 2), d_both[:, ::-1, n:].transpose(1, 0, 2)])
    g["U"] = np.zeros_like(model["U"])
    d_gates = np.zeros((words + 1, 2, 3 * n), np.float32)
    d_h = np.zeros((2, b, n), np.float32)
    sides = (at, at[:, ::-1])
    for step in range(t - 1, -1, -1):
        h, z, r, un, new = cache[step]
        d_h = d_h + d_states[:, step]
        d_new = d_h * (1 - z) * (1 - new**2)
        d_z = d_h * (h - new) * z * (1 - z)
        d_r = d_new * un * r * (1 - r)
        d_u = np.concatenate([d_z, d_r, d_new * r], axis=2)
        d_x = np.concatenate([d_z, d_r, d_new], axis=2)
        g["U"] += np.matmul(h.transpose(0, 2, 1), d_u)
        d_h = d_h * z + np.matmul(d_u, model["U"].transpose(0, 2, 1))
        for d, side in enumerate(sides):
            np.add.at(d_gates, (side[:, step], d), d_x[d])
    g["b"] = d_gates.reshape(-1, 6 * n).sum(axis=0)
    return g, d_gates[:-1].reshape(-1, 6 * n)


def windows(n: int) -> np.ndarray:
    """Places of the words of all windows of a text of ``n`` words; -1 after its end. No words: one empty window."""
    starts = np.arange(0, max(1, n - (WINDOW - STRIDE)), STRIDE)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, -1)


class Batch:
    """Texts as windows over the distinct words of all of them."""

    def __init__(self, texts: list[str | None]):
        known: dict[bytes, int] = {}
        number = known.setdefault
        parts, sizes = [], []
        for text in texts:
            place = np.fromiter((number(w, len(known)) for w in words_of(text, lower=True)), np.int32)
            at = windows(len(place))
            parts.append(np.where(at >= 0, np.append(place, 0)[at], -1).astype(np.int32))
            sizes.append(len(at))
        self.at = np.concatenate([np.empty((0, WINDOW), np.int32), *parts])
        self.first = np.cumsum(sizes) - sizes
        self.words = list(known)

    def worst(self, logits: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(logits, self.first)

    def logits(self, model: dict, features, rows: int = 4_096) -> np.ndarray:
        gates = word_gates(model, features)
        return np.concatenate([forward(model, gates, self.at[i : i + rows]) for i in range(0, len(self.at), rows)])


def _adam(model: dict, grads: dict, state: dict, step: float) -> None:
    state["t"] = state.get("t", 0) + 1
    for k, g in grads.items():
        m, v = state.setdefault(k, [np.zeros_like(g), np.zeros_like(g)])
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        fix = np.sqrt(1 - 0.99 ** state["t"]) / (1 - 0.9 ** state["t"])
        model[k] = model[k] - (step * fix * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def _keyness(batch: Batch, features, labels: np.ndarray) -> np.ndarray:
    """Log odds of each word's buckets among toxic texts (the mean of its word's and its best character run's)."""
    ids, buckets, starts, counts = features
    share = [np.full((2, BUCKETS), 0.5) for _ in "wc"]
    ends = np.append(batch.first[1:], len(batch.at))
    for s, e, label in zip(batch.first, ends, labels):
        some = np.unique(batch.at[s:e])
        some = some[some >= 0]
        share[0][label][np.unique(ids[some])] += 1
        runs = np.concatenate([np.empty(0, np.int64), *(buckets[starts[w] : starts[w] + counts[w]] for w in some)])
        share[1][label][np.unique(runs)] += 1
    word, char = (np.log(s[1] / (labels == 1).sum() / s[0] * (labels == 0).sum()) for s in share)
    best = np.zeros(len(ids))
    best[counts > 0] = np.maximum.reduceat(char[buckets], starts[counts > 0]) if len(buckets) else 0
    return word[ids] + best


def train(texts: list[str | None], labels: list[int], seed: int = 3) -> dict[str, np.ndarray]:
    """A model for texts (toxic: 1).  Each epoch takes each text's worst window so far, and of clean texts another too.

    At first, the worst window is the one with the word that is most particular to toxic texts. Without both
    classes the model is untrained.
    """
    model, labels = new_model(seed), np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return model
    rnd = np.random.default_rng(seed)
    texts, labels = [*texts, None], np.append(labels, 0)  # no words, not toxic
    batch = Batch(texts)
    ids, buckets, starts, counts = features = word_features(batch.words)
    owner = np.repeat(np.arange(len(ids)), counts)
    mean = (1 / np.maximum(counts, 1)).astype(np.float32)
    key = np.append(_keyness(batch, features, labels), -9.0)[batch.at]
    logits, state = key.max(axis=1), {}
    ends = np.append(batch.first[1:], len(batch.at))
    for epoch in range(EPOCHS):
        worst = np.array([s + logits[s:e].argmax() for s, e in zip(batch.first, ends)])
        clean = labels == 0
        other = rnd.integers(batch.first[clean], ends[clean])
        chosen = np.concatenate([worst, other])
        target = np.concatenate([labels, np.zeros(len(other), np.int64)])
        order = rnd.permutation(len(chosen))
        for s in range(0, len(order), 64):
            rows = order[s : s + 64]
            used, at = np.unique(batch.at[chosen[rows]], return_inverse=True)
            at = at.reshape(len(rows), WINDOW) - (used[0] < 0)
            used = used[used >= 0]
            runs = np.concatenate([np.empty(0, np.int64), *(np.arange(starts[w], starts[w] + counts[w]) for w in used)])
            part = ids[used], buckets[runs], np.cumsum(counts[used]) - counts[used], counts[used]
            x = inputs(model, part)
            seen = rnd.random(len(used)) >= DROPPED  # of the other words, only the characters are seen
            x[:, :WIDTH] *= seen[:, None]
            gates = np.concatenate([x @ model["W"] + model["b"], model["b"][None]])
            logit, kept = forward(model, gates, at, keep=True)
            wrong = (_sigmoid(logit) - target[rows]).astype(np.float32) / len(rows)
            grads, d_gates = backward(model, at, wrong, kept, len(used))
            grads["W"] = x.T @ d_gates
            d_x = d_gates @ model["W"].T
            d_x[:, :WIDTH] *= seen[:, None]
            grads["word"], grads["char"] = np.zeros_like(model["word"]), np.zeros_like(model["char"])
            np.add.at(grads["word"], part[0], d_x[:, :WIDTH])
            place = np.repeat(np.arange(len(used)), part[3])
            np.add.at(grads["char"], part[1], d_x[place, WIDTH:] * mean[used][place][:, None])
            _adam(model, grads, state, STEP * (1 - epoch / EPOCHS))
        if epoch + 1 < EPOCHS:
            logits = batch.logits(model, features)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list, list]:
    """Whole texts and labels to train on: of each class, the ``per_class`` rows of least hash that are not held out, as long
    as they have ``SAMPLE_CHARS`` characters together (a text that has more by itself is left out).  Both bounds keep what the
    driver gets small.

    A document with both labels is toxic; of several texts of one id the longest is taken, then the first in order;
    null texts are not trained on. Labels that are null or neither 0 nor 1, and those without a document, count for nothing.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(
        "id is not null and toxic in (0, 1)").where(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows = texts.select("id", F.length("text").alias("n")).groupBy("id").agg(F.max("n").alias("n")).where(
        F.col("n") <= SAMPLE_CHARS).join(ids, "id")
    by_hash = [F.xxhash64("id"), F.col("id")]
    so_far = F.sum("n").over(Window.orderBy(*by_hash))  # of per_class rows
    chosen = [rows.where(f"toxic = {c}").orderBy(*by_hash).limit(per_class).withColumn("all", so_far).where(F.col("all") <= SAMPLE_CHARS)
              for c in (0, 1)]
    few = chosen[0].unionByName(chosen[1]).select("id", "toxic", "n")  # at most 2 * per_class rows
    found = texts.withColumn("n", F.length("text")).join(F.broadcast(few), ["id", "n"]).groupBy("id", "toxic").agg(
        F.min("text").alias("text")).orderBy("id").collect()
    return [r.text for r in found], [r.toxic for r in found]


def held_out(id_col: str):
    """Whether a row is only tested on: crc32(id as text) mod 5 is 0; a row without id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    return train(*labelled_sample(docs, labels))


def _score(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = Batch(batch.column("text").to_pylist())
        logits = texts.logits(model, word_features(texts.words))
        score = 1 / (1 + np.exp(-texts.worst(logits).astype(np.float64)))
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(score)], ["rest", "score"])


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: rest (a struct of its columns), score (0 to 1): that of the worst of all windows of the text.

    Windows of 48 words begin every 32 words; the whole text is scored.  Null and empty
    texts are one empty window. Repeated rows score alike. An empty table gives no rows.
    """
    docs = docs.select(F.struct("*").alias("rest"), F.col(text_col).cast("string").alias("text"))
    kinds = docs.select("rest").schema.add("score", "double")
    return docs.mapInArrow(tidy(lambda it: _score(it, model)), kinds)


def reject(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``."""
    return score(docs, model, text_col).where(F.col("score") < threshold).select("rest.*")
