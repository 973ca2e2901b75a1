"""Byte-level BPE against the library the rank file is made for, and exact round trips."""

import random

import public_tokenizers
import pytest
import tiktoken

from feedfold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(1)
    alphabet = "abcdeABC  \n\t.,'1234éßñ漢字🙂‍\x00\x1c\x85\xa0 "
    some = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))) for _ in range(400)]
    return some + ["", " ", "\n\n \n", "it's we'll I'M", "<|endoftext|>", "a" * 3_000, " " * 2_000, "x y " * 100_000,
                   "".join(rnd.choice("lowerst") for _ in range(20_000)), "".join(map(chr, range(0x20, 0x3000)))]


def test_words(ranks, library):
    rnd = random.Random(2)
    for _ in range(3_000):
        word = bytes(rnd.choice(b"abcdehnorst \xc3\xa9\xff") for _ in range(rnd.randrange(1, 40)))
        assert bpe.encode_word(word, ranks) == library._encode_single_piece(word)


def test_encode_and_decode(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10_000)  # many blocks
    rows = [(i, t, f"e{i}", 1) for i, t in enumerate(texts())] + [(None, "no id", None, 2), (7, None, "x", 3), (7, None, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, block int").repartition(3)
    coded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    got = bpe.decode(coded, PATH).collect()
    assert sorted((str(r.rest.doc_id), str(r.rest.ids), r.rest.block) for r in got) == sorted(
        (str(i), str(e), b) for i, _, e, b in rows)
    by = {(r.rest.doc_id, r.rest.block): r for r in got}
    for i, text, _, b in rows:
        assert by[i, b].ids == library.encode_ordinary(text or "")
        assert bytes(by[i, b].decoded).decode() == (text or "")


def test_unknown_ids_null_lists_and_empty_tables(spark):
    coded = spark.createDataFrame([([31373, 60_000, -1], b"old"), (None, b"old"), ([], b"old")], "ids array<int>, decoded binary")
    got = [bytes(r.decoded) for r in bpe.decode(coded, PATH).collect()]
    assert got == ["hello��".encode(), b"", b""]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(empty, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_blocks_are_not_shuffled_again(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = bpe.encode(docs, PATH, public_tokenizers.PATTERN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(block") == 1 and plan.count("Exchange hashpartitioning(share") == 1


def test_the_table_of_tokens_is_bounded():
    with pytest.raises(ValueError):
        bpe.load_ranks(PATH, most=10)
