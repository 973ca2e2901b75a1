"""A Merkle tree over the rows of a dataset, with a proof for each row, by time-forward processing.

Rows are leaves, in order of id within their group; two consecutive nodes make one of the next
level until a group has one node, its subroot, and the subroots make the root likewise.  Positions
come from a range partitioning and sums of its counts, so no group is ever in one task.

A tree is cut into blocks of ``2 ** HEIGHT`` leaves.  In a task, a priority queue in order of node
label (level, group, index), which goes to disk beyond a bound, delivers the digests of children to
parents; a sweep in the reversed order delivers to each node the suffix of its proof, the siblings
from its own level up to the root.  The tops of blocks are the leaves of the next round, so a
round has a ``2 ** HEIGHT``-th of the rows of the one before.
"""

from __future__ import annotations

import heapq
import marshal
import tempfile
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import tidy, written

HEIGHT = 10  # levels of a block
HELD = 50_000  # messages or records in memory, of a queue or a tape
MOST_RUNS = 64  # files of a queue, before they are merged into one


# Queue and tape, both bounded in memory ------------------------------------------------

def _records(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield marshal.load(file)
        except EOFError:
            file.close()
            return


class ExternalQueue:
    """Messages (tuples that begin with their label) come out in order; more than ``held`` are kept in sorted files."""

    def __init__(self, held: int = HELD):
        self.held = held
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # (first message, number, the others)
        self.number = 0

    def _add_run(self, messages) -> None:
        file = tempfile.TemporaryFile()
        for m in messages:
            marshal.dump(m, file)
        self.number += 1
        others = _records(file)
        if (first := next(others, None)) is not None:
            heapq.heappush(self.runs, (first, self.number, others))

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            if len(self.runs) >= MOST_RUNS:
                runs, self.runs = self.runs, []
                self._add_run(heapq.merge(*([first] for first, _, _ in runs), *(others for _, _, others in runs)))
            messages, self.heap = sorted(self.heap), []
            self._add_run(messages)

    def first(self) -> tuple | None:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            return self.runs[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, number, others = self.runs[0]
            following = next(others, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, others))
            return message
        return heapq.heappop(self.heap)


class Tape:
    """Records that are read back from the last to the first; more than ``held`` are kept in a file."""

    def __init__(self, held: int = HELD):
        self.held = held
        self.recent: list[tuple] = []
        self.file = None
        self.places: list[int] = []

    def append(self, record: tuple) -> None:
        self.recent.append(record)
        if len(self.recent) >= self.held:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.places.append(self.file.tell())
            marshal.dump(self.recent, self.file)
            self.recent = []

    def backwards(self) -> Iterator[tuple]:
        yield from reversed(self.recent)
        for place in reversed(self.places):
            self.file.seek(place)
            yield from reversed(marshal.load(self.file))
        if self.file is not None:
            self.file.close()


# The sweeps of one task ----------------------------------------------------------------

def parent(children: list[bytes]) -> bytes:
    """The digest of one or two nodes: sha256 of their digests as lowercase hex."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def levels(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    return (n - 1).bit_length()


def height(total: int, turn: int) -> int:
    """Levels of the blocks in a round (0 is the first) of a group with ``total`` leaves."""
    below = HEIGHT * turn
    return min(HEIGHT, levels((total + (1 << below) - 1) >> below))


def upward(leaves: Iterator[tuple[int, int, int, bytes]], turn: int = 0, tape: Tape | None = None,
           held: int = HELD) -> Iterator[tuple[int, int, int, bytes]]:
    """(group, block, total, digest) of each block of the leaves (group, position, total leaves of the group, digest)."""
    queue = ExternalQueue(held)
    for group, at, total, digest in leaves:
        if height(total, turn):
            queue.push((1, group, at >> 1, at & 1, digest, total))
        else:
            yield group, at, total, digest
    while (head := queue.first()) is not None:
        level, group, at = label = head[:3]
        children, total = [], head[5]
        while (head := queue.first()) is not None and head[:3] == label:
            children.append(queue.pop()[4])
        digest = parent(children)
        if tape is not None:
            tape.append((level, group, at, total, children))
        if level < height(total, turn):
            queue.push((level + 1, group, at >> 1, at & 1, digest, total))
        else:
            yield group, at, total, digest


def downward(tape: Tape, queue: ExternalQueue) -> Iterator[tuple[tuple, tuple]]:
    """The leaves on the tape with what their nodes were told; ``queue`` has the messages to the tops of blocks."""
    for record in tape.backwards():
        level, group, at = record[:3]
        message = queue.pop()
        assert message[:3] == (-level, -group, -at), "a node has no message"
        suffix, *more = message[3:]
        if not level:
            yield record, (suffix, *more)
            continue
        children = record[4]
        for bit in range(len(children)):
            told = children[1 - bit] + suffix if len(children) == 2 else suffix
            queue.push((1 - level, -group, -(2 * at + bit), told, *more))


# Rounds --------------------------------------------------------------------------------

NODE = ("grp", "pos", "total", "digest")
KINDS = {"grp": pa.int64(), "pos": pa.int64(), "total": pa.int64(), "digest": pa.binary(), "suffix": pa.binary(),
         "subroot": pa.binary(), "folded": pa.binary()}
PORTION = 10_000  # rows of a batch that goes out


def _batches(rows: Iterator[tuple], names: tuple[str, ...], kinds: dict) -> Iterator[pa.RecordBatch]:
    portion: list[tuple] = []

    def made():
        columns = zip(*portion) if portion else ((),) * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, columns)], list(names))

    for row in rows:
        portion.append(row)
        if len(portion) == PORTION:
            yield made()
            portion.clear()
    yield made()


def _rows(batches: Iterator[pa.RecordBatch], names) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names))


def _up(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    return _batches(upward(_rows(batches, NODE), turn), NODE, KINDS)


def _down(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    """Nodes, and messages to blocks (rows without a digest); each node is given its suffix."""
    tape, queue = Tape(), ExternalQueue()

    def leaves():
        for group, at, total, digest, suffix, subroot in _rows(batches, (*NODE, "suffix", "subroot")):
            if digest is None:
                queue.push((-height(total, turn), -group, -at, suffix, subroot))
            else:
                tape.append((0, group, at, total, digest))
                yield group, at, total, digest

    for _ in upward(leaves(), turn, tape):
        pass
    told = ((group, at, total, digest, *message) for (_, group, at, total, digest), message in downward(tape, queue))
    return _batches(told, (*NODE, "suffix", "subroot"), KINDS)


TREE = "grp long, pos long, total long, digest binary"
TOLD = f"{TREE}, suffix binary, subroot binary"


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round; in the last each group has one."""
    rounds, most = [nodes], nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        dealt = rounds[-1].repartition("grp", F.shiftright("pos", HEIGHT))
        turn = len(rounds) - 1
        rounds.append(written(dealt.mapInArrow(tidy(lambda it, turn=turn: _up(it, turn)), TREE), "tree-tops"))
        most = (most + 2**HEIGHT - 1) >> HEIGHT
    return rounds


def _proofs(rounds: list[DataFrame], told: DataFrame) -> DataFrame:
    """The leaves with suffix and subroot; ``told`` has both for the top of each group."""
    told = told.select("grp", "pos", "total", "suffix", "subroot")
    for turn, nodes in reversed(list(enumerate(rounds[:-1]))):
        nodes = nodes.select(*NODE, F.lit(None).cast("binary").alias("suffix"), F.lit(None).cast("binary").alias("subroot"),
                             F.shiftright("pos", HEIGHT).alias("block"))
        messages = told.select("grp", "pos", "total", F.lit(None).cast("binary").alias("digest"), "suffix", "subroot",
                               F.col("pos").alias("block"))
        dealt = nodes.unionByName(messages).repartition("grp", "block").sortWithinPartitions("grp", "pos")
        told = written(dealt.mapInArrow(tidy(lambda it, turn=turn: _down(it, turn)), TOLD), "tree-proofs")
    return told


# Positions -----------------------------------------------------------------------------

def _placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (lang, id, leaf, more) with grp (rank of lang), pos (rank in the group), total (leaves of the group).

    Rows are range partitioned, so that neither a group nor equal rows meet in one task; windows
    run over counts of partitions only.
    """
    order = ["lang", "id", "leaf", "tie"]
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(dealt.drop("tie").withColumn("place", F.monotonically_increasing_id()), "leaves-in-order")
    part = F.shiftright("place", 33)
    named = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # null first, and equal to itself
    placed = placed.withColumn("part", part).withColumn("name", named)
    counts = placed.groupBy("part", "name").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    of_group = Window.partitionBy("name")
    counts = counts.withColumn("before", F.sum("n").over(of_group.orderBy("part")) - F.col("n")).withColumn(
        "total", F.sum("n").over(of_group))
    counts = written(counts, "leaf-counts")
    # A group is numbered where it begins: groups that begin in earlier partitions, and before it in its own.
    begins = counts.where("before = 0")
    parts = begins.groupBy("part").count().withColumn(
        "earlier", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")
    within = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    numbers = begins.join(parts, "part").select("name", (F.col("earlier") + within).alias("grp"))
    counts = counts.join(numbers, "name").select("part", "name", "first", "before", "total", "grp")
    return placed.join(counts, ["part", "name"]).withColumn("pos", F.col("place") - F.col("first") + F.col("before")).drop(
        "place", "first", "before", "part", "name")


# The operator --------------------------------------------------------------------------

def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields, each ``-`` if null, else UTF-8 byte count, ``:`` and value."""
    parts = (F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields)
    return F.sha2(F.concat(*parts), 256)


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang",
             claimed: Column | None = None) -> DataFrame:
    """Per row of ``docs``: id, lang (its group), position, total (leaves of the group), group_rank, groups, leaf,
    subroot, root (hex), proof (the siblings' digests, 32 bytes each, from the leaf to the root), claimed.

    A leaf is made of ``fields`` in their order.  ``claimed`` is an expression over ``docs`` of another
    leaf (hex) to be held against the proof, null for none.

    Null groups are a group, before all others; null ids come first in theirs. Rows of one id, repeated
    ones too, are leaves of their own, in order of their digests. Null and empty fields differ. A text
    of any length is one field. An empty table gives no rows. Other columns may have any names.
    """
    leaves = written(docs.select(
        F.col(f"`{group_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").cast("long").alias("id"),
        F.unhex(leaf_digest(*(F.col(f"`{c}`") for c in fields))).alias("leaf"),
        F.unhex(claimed if claimed is not None else F.lit(None).cast("string")).alias("claimed")), "leaves")
    placed = written(_placed(leaves), "leaves-placed")
    rounds = _rounds(placed.select("grp", "pos", "total", F.col("leaf").alias("digest")))
    # The subroots are a group of their own.
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.col("total").alias("leaves"), "digest")
    groups = subroots.count()
    subroots = written(subroots.withColumn("total", F.lit(groups).cast("long")), "subroots")
    over = _rounds(subroots.select(*NODE))
    root = over[-1].select("digest").first() if groups else None
    top = over[-1].select("grp", "pos", "total", F.lit(b"").alias("suffix"), "digest", F.lit(None).cast("binary").alias("subroot"))
    told = _proofs(over, top).select(F.col("pos").alias("grp"), "suffix")
    tops = rounds[-1].join(told, "grp").withColumn("subroot", F.col("digest"))
    proofs = _proofs(rounds, tops).select("grp", "pos", F.col("suffix").alias("proof"), "subroot")
    text = lambda c: F.lower(F.hex(c))
    return placed.join(proofs, ["grp", "pos"]).select(
        "id", "lang", F.col("pos").alias("position"), "total", F.col("grp").alias("group_rank"), F.lit(groups).cast("long").alias("groups"),
        text("leaf").alias("leaf"), text("subroot").alias("subroot"),
        F.lit(root[0].hex() if root else None).cast("string").alias("root"), "proof", text("claimed").alias("claimed"))


def fold(leaf: bytes, proof: bytes, at: int, total: int, group: int, groups: int) -> bytes:
    """The root that a leaf has with the siblings of its proof; sides follow from positions and sizes."""
    digest, used = leaf, 0
    for index, n in ((at, total), (group, groups)):
        while n > 1:
            siblings = [digest]
            if index ^ 1 < n:
                siblings.insert(0 if index & 1 else 1, proof[used : used + 32])
                used += 32
            digest = parent(siblings)
            index, n = index >> 1, (n + 1) >> 1
    return digest


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("leaf", "claimed", "proof", "position", "total", "group_rank", "groups")
    for batch in batches:
        roots = [fold(bytes.fromhex(claimed or leaf), *more).hex() for leaf, claimed, *more in _rows(iter([batch]), names)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, "folded_root"])


def verified(proofs: DataFrame) -> DataFrame:
    """Rows of ``manifest`` with folded_root, made again from the claimed leaf (else the leaf) and its proof, and verified,
    whether that is the root."""
    folded = proofs.mapInArrow(tidy(_fold), StructType([*proofs.schema, StructField("folded_root", StringType())]))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
