"""URL filters: rules of host and path, and logistic regression on hashed character n-grams where no rule fits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 2**16
GRAMS = (3, 4, 5)
SAMPLE = 4_096  # labelled urls that are trained on
EPOCHS, RATE, DECAY = 60, 0.5, 1e-4
MOST_RULES = 100_000
A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(A_TO_Z), slash + path


class Rules:
    """Rules (verdict, host, path): each fits its host and all subdomains, if the path starts with the rule's.

    The longest host and path together win; of equally long ones a block.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules are more than {MOST_RULES}")
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[2]), r[0] != "block")):
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Rule (host and path) and its verdict, or nulls."""
        best, at = (-1, False, None, None), 0
        while at >= 0 and host:
            own = host[at:]
            for start, verdict in self.by_host.get(own, ()):
                if path.startswith(start):
                    best = max(best, (len(own) + len(start), verdict == "block", own + start, verdict), key=lambda b: b[:2])
                    break
            at = host.find(".", at)
            at += at >= 0
        return best[2], best[3]


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct-by-place character runs of each url's host and path, and the url each belongs to."""
    buckets, owners = [], []
    for part, strings in enumerate((hosts, paths)):
        raw = [b"\1" + s.encode("utf-8", "surrogatepass") + b"\2" for s in strings]
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        owner = np.repeat(np.arange(len(raw)), sizes)
        ends = np.cumsum(sizes)
        for n in GRAMS:
            begins = np.arange(len(flat))
            begins = begins[begins + n <= ends[owner]] if len(flat) else begins
            h = np.full(len(begins), 2 * n + part, np.uint32)
            for j in range(n):
                h = (h ^ flat[begins + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            buckets.append((h * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64))
            owners.append(owner[begins])
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    return buckets, owners


def logits(model: dict, buckets: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    counts = np.maximum(np.bincount(owners, minlength=n), 1)
    return np.bincount(owners, model["weights"][buckets], minlength=n) / np.sqrt(counts) + model["bias"]


def train(urls: list[str | None], labels: list[int], seed: int = 1) -> dict:
    """Logistic regression (block: 1) by Adagrad with decay; without both classes it gives the one there is, or allows."""
    model = {"weights": np.zeros(BUCKETS), "bias": 0.0}
    y = np.asarray(labels, np.float64)
    if len(set(labels)) < 2:
        model["bias"] = 4.0 if len(y) and y[0] else -4.0
        return model
    buckets, owners = grams(*zip(*map(parts, urls)))
    scale = 1 / np.sqrt(np.maximum(np.bincount(owners, minlength=len(y)), 1))
    order = np.argsort(owners, kind="stable")
    buckets, first = buckets[order], np.searchsorted(owners[order], np.arange(len(y) + 1))
    rnd, seen, seen_bias = np.random.default_rng(seed), np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(EPOCHS):
        for rows in np.array_split(rnd.permutation(len(y)), max(1, len(y) // 64)):
            own = np.concatenate([buckets[first[r] : first[r + 1]] for r in rows])
            who = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
            z = np.bincount(who, model["weights"][own], minlength=len(rows)) * scale[rows] + model["bias"]
            wrong = (0.5 * np.tanh(z / 2) + 0.5 - y[rows]) / len(rows)
            used, place = np.unique(own, return_inverse=True)
            g = np.bincount(place, (wrong * scale[rows])[who]) + DECAY * model["weights"][used]
            seen[used] += g * g
            model["weights"][used] -= RATE * g / np.sqrt(seen[used])
            seen_bias += wrong.sum() ** 2
            model["bias"] -= RATE * wrong.sum() / np.sqrt(seen_bias)
    return model


def _parts_of(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [rules.find(*parts(u)) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array([v for _, v in found], pa.string())], ["url", "verdict"])


def labelled_by_rules(pages: DataFrame, rules: list[tuple[str, str, str]], most: int = SAMPLE,
                      url_col: str = "url") -> tuple[list[str], list[int]]:
    """A small labelled table: the urls that a rule decides, at most ``most`` of them, those of least hash."""
    own = Rules(rules)
    urls = pages.select(F.col(url_col).cast("string").alias("url")).where("url is not null")
    found = urls.mapInArrow(lambda it: _parts_of(it, own), "url string, verdict string").where("verdict is not null").distinct()
    rows = found.orderBy(F.xxhash64("url"), "url").limit(most).collect()
    return [r.url for r in rows], [int(r.verdict == "block") for r in rows]


def _judge(batches: Iterator[pa.RecordBatch], rules: Rules, model: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [parts(u) for u in batch.column("url").to_pylist()]
        hosts, paths = [h for h, _ in both], [p for _, p in both]
        score = np.empty(0) if not both else np.concatenate([
            logits(model, *grams(hosts[i : i + 5_000], paths[i : i + 5_000]), len(hosts[i : i + 5_000]))
            for i in range(0, len(hosts), 5_000)])
        found = [rules.find(h, p) for h, p in both]
        verdicts = [v or ("block" if s >= 0 else "allow") for (_, v), s in zip(found, score)]
        columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([r for r, _ in found], pa.string()),
                   pa.array(verdicts, pa.string()), pa.array(1 / (1 + np.exp(-score)), pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column("rest"), *columns], ["rest", "host", "path", "rule", "verdict", "score"])


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], model: dict, url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: rest (a struct of its columns), host, path, rule, verdict (allow or block), score.

    The verdict is the longest rule's; where none fits, block if the model's score is at least
    0.5. Null urls and urls without ``://`` have empty host and path, which no rule fits. Repeated rows are judged
    alike; an empty table gives no rows. Rows are judged where they are: nothing is shuffled.
    """
    own = Rules(rules)
    pages = pages.select(F.struct("*").alias("rest"), F.col(url_col).cast("string").alias("url"))
    kinds = pages.select("rest").schema
    for name in ("host", "path", "rule", "verdict"):
        kinds = kinds.add(name, "string")
    return pages.mapInArrow(lambda it: _judge(it, own, model), kinds.add("score", "double"))
