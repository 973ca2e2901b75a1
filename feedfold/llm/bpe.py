"""Byte-level BPE: distinct words are encoded where they arrive by hash, their ids go back to where they stood.

Documents are cut into blocks.  A block keeps its distinct words and, for every place,
the number of the word that stands there.  The distinct words of all blocks are shuffled by
their hash, packed in one row for each block and share of the hashes.  Whoever gets a share
encodes each of its words once, as long as it has MOST_KNOWN words at most: beyond, its memory is emptied and
words that come again are encoded again, to the same ids.  Ids go back in the same order, and a block
is put together again from the ids of its own words; the blocks themselves stay in their buckets.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .common import bucketed, give_back, tidy

BLOCK_CHARS = 8_000_000
IDS_AT_ONCE = 250_000  # that are decoded together
MOST_KNOWN = 2_000_000  # words that a task remembers at once
UNKNOWN = "�".encode()


def load_ranks(path: str, most: int = 1_000_000) -> dict[bytes, int]:
    """A rank file (base64 token, rank): at most ``most`` tokens, so that it may go to every task."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    if len(ranks) > most:
        raise ValueError(f"{len(ranks)} tokens are more than {most}")
    return ranks


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The pair of least rank is merged first, of equal ones the leftmost; n log n for long words."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))  # where the part that starts here ends; 0: no part starts here any more
    before = list(range(-1, n))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (rank := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if (left := before[i]) >= 0 and (rank := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.uint32(len(numbers)).tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _spread(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob[:4], np.uint32)[0])
    raw = pa.decompress(blob[4:], n * 4, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _packed(words: list[bytes]) -> dict:
    data = b"".join(words)
    return {"sizes": _squeezed(np.fromiter(map(len, words), np.uint32, len(words))), "length": len(data),
            "data": pa.compress(data, "zstd", asbytes=True)}


def _unpacked(sizes: bytes, length: int, data: bytes) -> list[bytes]:
    raw, ends = pa.decompress(data, length, "zstd", asbytes=True), np.cumsum(_spread(sizes), dtype=np.int64).tolist()
    return [raw[s:e] for s, e in zip([0, *ends], ends)]


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, shares: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    split = regex.compile(pattern).findall
    block = TaskContext.get().partitionId() << 32
    known: dict[str, int] = {}
    rests, codes, size = [], [], 0

    def row():
        flat = np.concatenate(codes)
        order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")  # frequent words get small numbers
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order), dtype=np.uint32)
        raw = [w.encode() for w in known]
        words = [raw[i] for i in order.tolist()]
        share = np.fromiter((xxhash.xxh3_64_intdigest(w) % shares for w in words), np.int64, len(words))
        sorted_by = np.argsort(share, kind="stable")
        some, first = np.unique(share[sorted_by], return_index=True)
        parts = [{"share": s, **_packed([words[i] for i in own.tolist()])}
                 for s, own in zip(some.tolist(), np.split(sorted_by, first[1:]))]
        every = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        columns = [pa.array([block], pa.int64()), pa.array([parts], schema.field("parts").type),
                   pa.array([_squeezed(share)], pa.binary()), every(pa.concat_arrays(rests)),
                   every(pa.array(list(map(len, codes)), pa.int32())), pa.array([_squeezed(number[flat])], pa.binary())]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        taken = 0
        for at, text in enumerate(batch.column(1)):
            words = split(text.as_py() or "")
            number = known.setdefault
            codes.append(np.fromiter((number(w, len(known)) for w in words), np.uint32, len(words)))
            size += len(text.as_py() or "") + 1
            if size >= BLOCK_CHARS:
                rests.append(batch.column(0).slice(taken, at + 1 - taken))
                yield row()
                block, taken, size, rests, codes, known = block + 1, at + 1, 0, [], [], {}
        if taken < batch.num_rows:
            rests.append(batch.column(0).slice(taken))
    if codes:
        yield row()


def _encode_words(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their share: each distinct word of a share is encoded once, for all blocks that have it,
    and again once the memory of MOST_KNOWN words was emptied."""
    last, known = None, {}
    for batch in batches:
        sizes, ids = [], []
        for share, *packed in zip(*(batch.column(k).to_pylist() for k in ("share", "sizes", "length", "data"))):
            if share != last or len(known) > MOST_KNOWN:
                last, known = share, {}
            flat, n = [], []
            for word in _unpacked(*packed):
                if (found := known.get(word)) is None:
                    found = known[word] = encode_word(word, ranks)
                flat += found
                n.append(len(found))
            sizes.append(_squeezed(np.array(n, np.uint32)))
            ids.append(_squeezed(np.array(flat, np.uint32)))
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("share"), pa.array(sizes, pa.binary()),
                                          pa.array(ids, pa.binary())], ["block", "share", "sizes", "ids"])


def _assemble(block: pa.Table, pieces: pa.Table, schema: pa.Schema) -> pa.Table:
    if not block.num_rows:
        return schema.empty_table()
    share = _spread(block["share"][0].as_py())
    pieces = pieces.take(np.argsort(pieces["share"].to_numpy()))  # the order of the words when sorted by their share
    none = [np.empty(0, np.uint32)]
    own = np.concatenate(none + [_spread(b) for b in pieces["sizes"].to_pylist()]).astype(np.int64)
    ids = np.concatenate(none + [_spread(b) for b in pieces["ids"].to_pylist()])
    sizes, starts = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    sorted_by = np.argsort(share, kind="stable")
    sizes[sorted_by], starts[sorted_by] = own, np.cumsum(own) - own
    lengths = np.array(block["lengths"][0].values).astype(np.int64)
    codes = _spread(block["codes"][0].as_py())
    out = ids[gathered(starts[codes], sizes[codes])]
    ends = np.concatenate([[0], np.cumsum(sizes[codes])])[np.concatenate([[0], np.cumsum(lengths)])]
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.astype(np.int32), pa.int32()))
    raw = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(out)])
    rest = block["rest"][0].values
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip((rest, lists, raw), schema)], schema=schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: rest (a struct of its other columns, at least one), ids (array of int), raw (the ids as
    little-endian unsigned 32-bit numbers): each match of ``pattern`` encoded by itself.

    ``path`` names a rank file.  No special tokens.  Null and empty texts have no ids;
    repeated rows are encoded alike; an empty table gives no rows.  A text of any length is
    one row of one block.
    """
    ranks = load_ranks(path)
    others = [c for c in docs.columns if c != text_col]
    docs = docs.select(F.struct(*others).alias("rest"), F.col(text_col).cast("string").alias("text"))
    rest = docs.schema["rest"].dataType
    part = StructType().add("share", IntegerType()).add("sizes", "binary").add("length", IntegerType()).add("data", "binary")
    block_type = (StructType().add("block", "long").add("parts", ArrayType(part)).add("share", "binary")
                  .add("rest", ArrayType(rest)).add("lengths", ArrayType(IntegerType())).add("codes", "binary"))
    block_schema = to_arrow_schema(block_type)
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(docs.mapInArrow(tidy(lambda it: _blocks(it, pattern, shares, block_schema)), block_type), "block", "bpe-blocks")
    words = blocks.select("block", F.explode("parts").alias("part")).select("block", "part.*")
    pieces = words.repartition("share").sortWithinPartitions("share").mapInArrow(
        tidy(lambda it: _encode_words(it, ranks)), "block long, share int, sizes binary, ids binary")
    out_type = StructType().add("rest", rest).add("ids", ArrayType(IntegerType())).add("raw", "binary")
    out_schema = to_arrow_schema(out_type)
    places = blocks.select("block", "share", "rest", "lengths", "codes")

    def assembled(block: pa.Table, found: pa.Table) -> pa.Table:
        out = _assemble(block, found, out_schema)
        give_back()
        return out

    return places.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(
        assembled, out_type)


def _decode(batches: Iterator[pa.RecordBatch], at: int, blob: np.ndarray, starts: np.ndarray,
            sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    last = len(starts) - 1  # the entry for ids that are in no table
    for whole in batches:
        share = np.cumsum(whole.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // IDS_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), whole.num_rows]
        for s, e in zip(edges, edges[1:]):
            batch = whole.slice(s, e - s)
            lists = batch.column(at)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ids = np.where((ids < 0) | (ids >= last), last, ids)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            places = np.concatenate([[0], np.cumsum(sizes[ids])])[np.concatenate([[0], ends])]
            raw = blob[gathered(starts[ids], sizes[ids])].tobytes()
            texts = pa.array([raw[s:e] for s, e in zip(places, places[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])


def decode(coded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with ``decoded`` (binary): the bytes of the ids, looked up in the token-byte table of ``path``.

    The table is bounded (see ``load_ranks``) and goes to every task, where it is joined by
    id, position kept.  Ids in no table give U+FFFD; null lists give no bytes. A column ``decoded`` that is there already
    is replaced.
    """
    ranks = load_ranks(path)
    tokens = [UNKNOWN] * (max(ranks.values(), default=-1) + 2)
    for token, rank in ranks.items():
        tokens[rank] = token
    sizes = np.array(list(map(len, tokens)), np.int64)
    blob, starts = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
    coded = coded.drop("decoded")
    at = coded.columns.index(ids_col)
    return coded.mapInArrow(tidy(lambda it: _decode(it, at, blob, starts, sizes)), StructType([*coded.schema.fields, StructField("decoded", BinaryType())]))
