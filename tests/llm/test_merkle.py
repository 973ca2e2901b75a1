"""Trees and proofs against a plain tree built level by level."""

import hashlib
import random

import pytest

from feedfold.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The levels, from the leaves to the root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        out += level[at ^ 1 : (at ^ 1) + 1]
        at >>= 1
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf_of(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([leaf for _, leaf, _ in sorted(groups[g], key=lambda x: x[:2])]) for g in names]
    over = tree([t[-1][0] for t in trees])
    out = []
    for i, (g, t) in enumerate(zip(names, trees)):
        for at, (_, leaf, doc) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            out.append((doc, g, leaf, t[-1][0], over[-1][0], "".join(siblings(t, at) + siblings(over, i))))
    return sorted(out, key=str)


def corpus(n, langs, seed=1):
    rnd = random.Random(seed)
    rows = [(i if i % 50 else None, rnd.choice(["a", None, ""]), rnd.choice(langs), rnd.choice([i, None]),
             rnd.choice(["x" * rnd.randrange(60), "\u00e9\u4e16", "", None])) for i in range(n)]
    return rows + rows[: n // 10]


@pytest.mark.parametrize("height, n, langs", [(2, 300, ["de", "en", "en", "en", None, "", "\u00e9", "z\U0001f600", "z\uffff"]),
                                              (10, 40, ["en"]), (3, 1, ["en"]), (1, 90, [None] + [str(i) for i in range(30)])])
def test_against_plain_trees(spark, monkeypatch, height, n, langs):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = corpus(n, langs)
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA + ", leaf int, claimed string")
    out = merkle.verified(merkle.manifest(docs, FIELDS)).collect()
    assert sorted(((r.id, r.lang, r.leaf, r.subroot, r.root, r.proof.hex()) for r in out), key=str) == brute(rows)
    assert all(r.verified and r.folded_root == r.root for r in out)


def test_another_leaf_does_not_verify(spark):
    rows = corpus(60, ["de", "en"], 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    claimed = F.when(F.col("doc_id") % 3 == 0, F.sha2(F.lit("other"), 256))
    for r in merkle.verified(merkle.manifest(docs, FIELDS, claimed=claimed)).collect():
        changed = r.id is not None and r.id % 3 == 0
        assert r.verified == (not changed) and (r.folded_root == r.root) == r.verified
    assert merkle.manifest(docs.where("false"), FIELDS).count() == 0


def test_queue_and_tape_beyond_memory():
    rnd = random.Random(2)
    queue, plain = merkle.ExternalQueue(held=5), []
    for _ in range(3_000):
        if plain and rnd.random() < 0.3:
            assert queue.first() == min(plain)
            m = queue.pop()
            assert m == min(plain)
            plain.remove(m)
        else:
            m = (rnd.randrange(100), rnd.randbytes(3))
            queue.push(m), plain.append(m)
    assert len(queue.runs) <= merkle.MOST_RUNS + 1
    assert [queue.pop() for _ in plain] == sorted(plain) and queue.first() is None
    tape = merkle.Tape(held=7)
    for i in range(100):
        tape.append((i, b"x"))
    assert [r[0] for r in tape.backwards()] == list(range(99, -1, -1))


def test_sweeps_in_small_memory(monkeypatch):
    """A block that is far larger than what is held."""
    monkeypatch.setattr(merkle, "HEIGHT", 12)
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(1_001)]
    tape, tops = merkle.Tape(held=10), merkle.ExternalQueue(held=10)

    def given():
        for i, leaf in enumerate(leaves):
            tape.append((0, 7, i, len(leaves), leaf))
            yield 7, i, len(leaves), leaf

    plain = tree([x.hex() for x in leaves])
    (top,) = merkle.upward(given(), 0, tape, held=10)
    assert top == (7, 0, 1_001, bytes.fromhex(plain[-1][0]))
    tops.push((-10, -7, 0, b"end", b""))
    got = {record[2]: told[0] for record, told in merkle.downward(tape, tops)}
    assert got == {i: bytes.fromhex("".join(siblings(plain, i))) + b"end" for i in range(1_001)}
