"""Removal of passages that start earlier in the corpus, by suffix automata of reference shards.

Each window of ``window`` words has an anchor, the least hash among its runs of eight
words, and neighbouring windows of one anchor make a segment.  Equal windows have equal
anchors, so documents are routed to shards by anchor: a shard holds the distinct segments
of one anchor in order of their first occurrence.  Each segment is streamed through the
suffix automaton of the shard's earlier ones; matching statistics of at least
``window`` words are the spans to remove.  Further copies of a segment need no automaton.

A shard is bounded: an anchor whose distinct segments have more than ``SHARD_WORDS`` words is
dealt again, with the whole window as anchor.  Such a shard holds one distinct window, so the
first place where it starts is a minimum that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mixed, odd_numbers, run_hashes, slices, tidy, word_hashes, words_of, written

GRAM = 8
SAMPLE = 2_000  # documents that are looked at for grams that very many documents share
HOT = 10  # such a gram is in that many of them
MOST_HOT = 100_000  # of such grams go to the tasks, those in most documents first
SHARD_WORDS = 100_000  # of one automaton
NO_ID = 2**63 - 1
REMOVED, FIRST, LARGE = 1, 2, 3  # kinds of rows; 0 is not judged yet
BASE = odd_numbers(1, 20)[0]
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def segments(text: str | None, window: int, hot: np.ndarray):
    """(anchor, content hash, first window, number of windows) of the segments of a text, or None.

    Grams in ``hot`` (sorted) are anchors only of windows that have no other.
    """
    words = words_of(text)
    m = len(words) - window + 1
    if m <= 0:
        return None
    h = word_hashes(words)
    grams = run_hashes(h, GRAM)
    order = grams >> np.uint64(1)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        order = order | (np.uint64(2**63) * (hot[place] == grams))
    at = np.arange(m) + np.lib.stride_tricks.sliding_window_view(order, window - GRAM + 1).argmin(axis=1)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    n = np.diff(np.append(start, m))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(BASE, len(h)))])
    content = (sums[start + n + window - 1] - sums[start]) * _powers(BASE_INVERSE, m)[start]
    return grams[at[start]], mixed(content + n.astype(np.uint64)), start, n


ROUTED = "key long, seg long, id long, th int, span long"  # span: kind, start and n in one number


def _packed(kind: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """In order of kind, then start; n, the windows of a segment, is at most ``window`` and below 2**16."""
    return (kind.astype(np.int64) << 48) | (start.astype(np.int64) << 16) | n.astype(np.int64)


def _unpacked(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return span >> 48, (span >> 16) & (2**32 - 1), span & (2**16 - 1)


def _batch(names: str, **columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    pairs = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) for c, k in pairs], [c for c, _ in pairs])


def _route(batches: Iterator[pa.RecordBatch], window: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments of the documents.  Of a hot anchor's equal segments only a task's first goes on; the others are decided."""
    for batch in slices(batches):
        found, best = [], {}
        for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
            if (s := segments(text.as_py(), window, hot)) is not None:
                found.append((np.full(len(s[0]), row), *s))
        if not found:
            continue
        row, key, seg, start, n = (np.concatenate(x) for x in zip(*found))
        ids, th = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
        kind = np.zeros(len(row), np.int32)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            many = np.flatnonzero(hot[place] == key)
            many = many[np.lexsort((start[many], ids[many], seg[many], key[many]))]
            again = np.concatenate([[False], (key[many][1:] == key[many][:-1]) & (seg[many][1:] == seg[many][:-1])])
            lead = many[np.maximum.accumulate(np.where(again, 0, np.arange(len(many))))] if len(many) else many
            later = again & ((ids[many] != ids[lead]) | (start[many] != start[lead]))
            kind[many[later]] = REMOVED
            key = np.where(kind == REMOVED, mixed(ids.view(np.uint64)), key)
        yield _batch(ROUTED, key=key.view(np.int64), seg=seg.view(np.int64), id=ids, th=th, span=_packed(kind, start, n))


JUDGED = "key long, id long, th int, span long"


def _judge(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of key, segment, id and span: which occurrences are copies, which firsts need matching, and the
    anchors (rows of kind ``LARGE``) whose firsts have more than ``SHARD_WORDS`` words.

    Keys of decided rows are mixed ids; they only pass through.  The state between batches is the last
    key with its number of words, its segment and one row.
    """
    names = ("key", "seg", "id", "th", "start", "n")
    lead = pending = None  # the last segment's first row; the first row of a key of which no second segment is known
    held = 0  # words of the firsts of the last key

    def out(rows, kind):
        packed = _packed(np.full(len(rows["key"]), kind), rows["start"], rows["n"])
        return _batch(JUDGED, **{k: rows[k] for k in ("key", "id", "th")}, span=packed)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {k: batch.column(k).to_numpy() for k in names[:4]}
        kind, rows["start"], rows["n"] = _unpacked(batch.column("span").to_numpy())
        passed = kind == REMOVED
        if passed.any():
            yield out({k: v[passed] for k, v in rows.items()}, REMOVED)
            rows = {k: v[~passed] for k, v in rows.items()}
            if passed.all():
                continue
        carried = lead is not None
        if carried:
            rows = {k: np.concatenate([lead[k], v]) for k, v in rows.items()}
        key, seg = rows["key"], rows["seg"]
        new_key = np.concatenate([[not carried], key[1:] != key[:-1]])
        new_seg = np.concatenate([[not carried], (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])])
        first = np.maximum.accumulate(np.where(new_seg, np.arange(len(key)), 0))
        copy = ~new_seg & ((rows["id"] != rows["id"][first]) | (rows["start"] != rows["start"][first]))
        yield out({k: v[copy] for k, v in rows.items()}, REMOVED)
        heads = np.flatnonzero(new_seg)
        if not len(heads):
            continue
        more = ~new_key[heads]  # not the first segment of its key
        several = more.copy()
        several[:-1] |= more[1:] & new_key[heads[:-1]]
        if pending is not None and more[0]:
            yield out(pending, FIRST)
        yield out({k: v[heads[several]] for k, v in rows.items()}, FIRST)
        # Words of each key's firsts so far; those of a key that goes on are carried along.
        shard = np.cumsum(new_key)[heads]
        sums = np.bincount(shard, weights=rows["n"][heads] + window - 1, minlength=shard[-1] + 1).astype(np.int64)
        before = held if carried else 0
        sums[0] += before  # of the key that was carried; bin 0 holds its firsts in this batch
        over = np.flatnonzero(sums > SHARD_WORDS)
        over = over[(over > 0) | (before <= SHARD_WORDS)]  # each anchor once
        if len(over):
            at = heads[np.searchsorted(shard, over)]
            yield out({k: v[at] for k, v in rows.items()}, LARGE)
        held = int(sums[shard[-1]])
        last = heads[-1:]
        if more[0] or len(heads) > 1 or new_key[heads[0]]:
            pending = None
        if new_key[last[0]]:
            pending = {k: v[last] for k, v in rows.items()}
        lead = {k: v[last] for k, v in rows.items()}


class SuffixAutomaton:
    """All runs of the sequences added so far; the next sequence starts anew at the root."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence) -> None:
        last = 0
        for c in sequence:
            last = self._extend(last, c)

    def _extend(self, last: int, c) -> int:
        following, link, length = self.next, self.link, self.length
        known = following[last].get(c)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, c, known)
        new = len(link)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c, q: int) -> int:
        following, link, length = self.next, self.link, self.length
        twin = len(link)
        following.append(dict(following[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = twin
        while p >= 0 and following[p].get(c) == q:
            following[p][c] = twin
            p = link[p]
        return twin

    def statistics(self, sequence) -> list[int]:
        """At each position, the length of the longest run ending there that is known."""
        following, link, length = self.next, self.link, self.length
        state = size = 0
        out = []
        for c in sequence:
            while state and c not in following[state]:
                state = link[state]
                size = length[state]
            if c in following[state]:
                state, size = following[state][c], size + 1
            out.append(size)
        return out


def _match(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of key and occurrence: the spans of windows that the shard's earlier segments hold."""
    shard, automaton = None, SuffixAutomaton()
    for batch in batches:
        found = []
        for key, doc, th, start, words in zip(*(batch.column(k).to_pylist() for k in ("key", "id", "th", "start", "words"))):
            words = words.split(b" ")
            if key != shard:
                shard, automaton = key, SuffixAutomaton()
            else:
                run = 0
                for at, size in enumerate([*automaton.statistics(words), 0]):
                    if size >= window:
                        run += 1
                    elif run:
                        found.append((doc, th, start + at - run - window + 1, run))
                        run = 0
            automaton.add(words)
        ids, th, start, n = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), (), ())))
        yield _batch("id long, th int, span long", id=ids, th=th, span=_packed(np.zeros(len(ids)), start, n))


def _lists(column: pa.Array) -> Iterator[pa.Array]:
    """The list of each row; null is an empty one."""
    flat = column.flatten()
    ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    for s, e in zip([0, *ends], ends):
        yield flat[s:e]


def _firsts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Key, start and n of the segments of each row."""
    for flat in _lists(column):
        yield flat.field("key").to_numpy(), *_unpacked(flat.field("span").to_numpy())[1:]


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Segments to match, as words, of the documents that have some."""
    names = "key long, id long, th int, start int, words binary"
    for batch in slices(batches):
        keys, rows, starts, cut = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for row, (text, (key, start, n)) in enumerate(zip(batch.column("text"), _firsts(batch.column("firsts")))):
            if not len(key):
                continue
            words = words_of(text.as_py())
            keys.append(key), starts.append(start), rows.append(np.full(len(key), row))
            cut += [b" ".join(words[s : s + k + window - 1]) for s, k in zip(start.tolist(), n.tolist())]
        rows = np.concatenate(rows)
        yield _batch(names, key=np.concatenate(keys), id=batch.column("id").to_numpy()[rows],
                     th=batch.column("th").to_numpy()[rows], start=np.concatenate(starts), words=cut)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window of the segments of large anchors, with two hashes of its words."""
    names = "seg long, seg2 long, id long, th int, start int"
    for batch in slices(batches):
        rows, starts, seg, seg2 = ([np.empty(0, np.int64)] for _ in range(4))
        for row, (text, (key, start, n)) in enumerate(zip(batch.column("text"), _firsts(batch.column("large")))):
            if not len(key):
                continue
            h = word_hashes(words_of(text.as_py()))
            at = np.unique(np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()))
            rows.append(np.full(len(at), row)), starts.append(at)
            seg.append(run_hashes(h, window)[at].view(np.int64))
            seg2.append(run_hashes(mixed(h), window)[at].view(np.int64))
        rows = np.concatenate(rows)
        yield _batch(names, seg=np.concatenate(seg), seg2=np.concatenate(seg2), id=batch.column("id").to_numpy()[rows],
                     th=batch.column("th").to_numpy()[rows], start=np.concatenate(starts))


def _drop(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        total, gone, kept = [], [], []
        for text, *both in zip(batch.column("text"), _lists(batch.column("copies")), _lists(batch.column("matched"))):
            words = words_of(text.as_py())
            edges = np.zeros(len(words) + 1, np.int64)  # where spans begin and end
            for spans in both:
                _, start, n = _unpacked(spans.to_numpy())
                np.add.at(edges, start, 1)
                np.add.at(edges, start + n + window - 1, -1)
            keep = np.cumsum(edges[:-1]) == 0
            total.append(len(words))
            gone.append(int(len(words) - keep.sum()))
            kept.append(b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)]).decode("utf-8", "replace"))
        columns = [batch.column("rest"), batch.column("text"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                   pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["rest", "text", "n_words", "n_removed", "kept"])


def _hot_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [np.unique(run_hashes(word_hashes(words_of(t.as_py())), GRAM)) for t in batch.column(0)]
        yield _batch("gram long", gram=np.concatenate([np.empty(0, np.uint64), *grams]).view(np.int64))


def hot_grams(docs: DataFrame) -> np.ndarray:
    """Grams that very many documents share, from a sample; they only steer the routing, so any set gives the same result."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    grams = docs.select("text").sample(share, seed=1).mapInArrow(_hot_grams, "gram long")
    rows = grams.groupBy("gram").count().where(F.col("count") >= HOT).orderBy(F.desc("count"), "gram").limit(MOST_HOT).select("gram").toPandas()
    return np.sort(rows["gram"].to_numpy(np.int64).view(np.uint64))


def _later_windows(windows: DataFrame) -> DataFrame:
    """(id, th, span) of the windows that start elsewhere first."""
    at = F.struct("id", "start")
    first = windows.groupBy("seg", "seg2").agg(F.min(at).alias("first"))
    # The key is made anew, so that the join has exchanges of its own, which AQE can split.
    first = first.select(fresh("seg").alias("seg"), fresh("seg2").alias("seg2"), "first")
    later = windows.join(first, ["seg", "seg2"]).where(at != F.col("first"))
    return later.select("id", "th", F.shiftleft(F.col("start").cast("long"), 16).bitwiseOR(F.lit(1)).alias("span"))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: rest (a struct of its columns), n_words, n_removed, kept (words left, one space between).

    A word goes if a window of ``window`` consecutive words of its document covers it whose
    words also start earlier: in a document with a smaller id, or earlier in the same one.
    Windows are judged on the input.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

    Null text has no words; texts shorter than a window stay. A null id comes after all others. Rows
    of one id are versions of one document: repeated rows are judged alike, and a window that
    starts at the same word of another version is not an earlier one. An empty table gives no rows.
    Columns of ``docs`` may have any names, those of the result and of this module too. Text is moved once in each
    join and stands once in each written table.
    """
    names, kind = docs.columns, docs.schema[text_col].dataType
    other = [F.col(f"`{c}`") for c in names if c != text_col]
    docs = docs.select(F.struct(*other).alias("rest"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("th", F.hash("text"))
    hot = hot_grams(docs)
    routed = docs.select("id", "th", "text").mapInArrow(tidy(lambda it: _route(it, window, hot)), ROUTED)
    judged = routed.repartition("key").sortWithinPartitions("key", "seg", "id", "span").mapInArrow(
        tidy(lambda it: _judge(it, window)), JUDGED)
    judged = written(judged, "repeats-judged")

    of = F.shiftright("span", 48)
    large = written(judged.where(of == LARGE).select("key").distinct(), "repeats-large").withColumn("large", F.lit(True))
    spans = judged.where(of < LARGE).join(large, "key", "left")
    first = F.struct("key", "span")
    lists = spans.groupBy("id", "th").agg(
        F.collect_list(F.when(of == REMOVED, F.col("span"))).alias("copies"),
        F.collect_list(F.when((of == FIRST) & F.col("large").isNull(), first)).alias("firsts"),
        F.collect_list(F.when((of == FIRST) & F.col("large"), first)).alias("large"))
    # With what its copies alone decide, a document without segments to match is done.
    marked = written(docs.join(lists, ["id", "th"], "left"), "repeats-marked")
    firsts = marked.where(F.size("firsts") > 0).select("id", "th", "text", "firsts").mapInArrow(
        tidy(lambda it: _cut(it, window)), "key long, id long, th int, start int, words binary").distinct()
    matched = firsts.repartition("key").sortWithinPartitions("key", "id", "start").mapInArrow(
        tidy(lambda it: _match(it, window)), "id long, th int, span long")
    windows = marked.where(F.size("large") > 0).select("id", "th", "text", "large").mapInArrow(
        tidy(lambda it: _windows(it, window)), "seg long, seg2 long, id long, th int, start int")
    matched = matched.unionByName(_later_windows(windows)).groupBy("id", "th").agg(F.collect_list("span").alias("matched"))
    # Only documents that had segments to match are shuffled once more.
    waiting = F.coalesce(F.size("firsts") + F.size("large"), F.lit(0)) > 0
    columns = ["rest", "text", "copies", "matched"]
    late = marked.where(waiting).drop("firsts", "large").join(matched, ["id", "th"], "left").select(columns)
    done = marked.where(~waiting).withColumn("matched", F.lit(None).cast("array<long>")).select(columns)
    kinds = docs.select("rest", "text").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")
    found = done.unionByName(late).mapInArrow(tidy(lambda it: _drop(it, window)), kinds)
    own = [(F.col("text").cast(kind) if c == text_col else F.col("rest").getField(c)).alias(c) for c in names]
    return found.select(F.struct(*own).alias("rest"), "n_words", "n_removed", "kept")
