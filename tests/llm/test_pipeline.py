"""The pipeline's stages against plain versions of them, each on its own input."""

import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from feedfold.llm import bpe, decontaminate, toxicity

from .test_minhash import brute as groups
from .test_substrings import brute as passages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with toxic texts, copies, near copies, shared passages, leaks, nulls and repeated rows."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randrange(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, f"{text(20)} {text(15)}") for i in range(12)]
    passage = text(60)
    docs, labels = [], []
    for i in range(360):
        body = text(rnd.randrange(30, 260))
        if i % 9 == 0:
            body += " vilefool grobzak vilefool"
        elif i % 10 == 1:
            body += f"\n{passage}\n" + text(20)
        elif i % 30 == 2:
            body = f"{text(30)} {items[i // 30][1]} {text(30)}"
        docs.append((i, body))
        if i % 2:
            labels.append((i, 1, int(i % 9 == 0)))
    docs += [(1000 + k, docs[k][1]) for k in (4, 5, 7)] + [(1010, docs[5][1] + " more"), (1011, None), (1012, ""), (None, text(40)),
                                                           (14, docs[14][1])]
    path = tmp_path_factory.mktemp("sf")
    table = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_on_its_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    key = lambda rows: sorted(map(str, rows))
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = corpus_pipeline.written(stage(spark, docs, folder), "test-stage")
        if name != "byte-level BPE":
            assert out.columns == docs.columns
            kept = [(r.doc_id, r.text) for r in out.collect()]
            assert all(r.n_chars == len(r.text or "") for r in out.collect())
        if name == "toxicity":
            gone = set(rows) - set(kept)
            assert {t for _, t in rows if t and "vilefool" in t} == {t for _, t in gone}
            model = toxicity.fitted(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            batch = toxicity.Batch([t for _, t in rows])
            logits = batch.worst(batch.logits(model, toxicity.word_features(batch.words)))
            assert key(kept) == key(r for r, x in zip(rows, logits) if x < 0)
        elif name == "MinHash near-dedup":
            gone = {i for i, *_, keep in groups(rows, 80) if keep is False}
            assert {1004, 1005, 1007, 1010} <= gone and key(kept) == key(r for r in rows if r[0] not in gone)
        elif name == "substring dedup":
            want = passages(list(dict.fromkeys(rows)))  # repeated rows are judged alike
            assert key(kept) == key((i, want[i][2] if i in want and want[i][1] else t) for i, t in rows)
            assert sum(w[1] > 0 for w in want.values()) > 10
        elif name == "benchmark decontamination":
            clean = [" ".join(map(bytes.decode, decontaminate.terms_of(i))) for i in items]
            assert key(kept) == key(r for r in rows if not any(
                i in " ".join(map(bytes.decode, decontaminate.terms_of(r[1]))) for i in clean))
            assert len(kept) < len(rows) - 5
        else:
            got = out.collect()
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
            assert key((r.doc_id, r.ids) for r in got) == key((i, library.encode_ordinary(t or "")) for i, t in rows)
        docs = out
    last = corpus_pipeline.run(spark, folder)
    assert last.columns == docs.columns and key(map(tuple, last.collect())) == key(map(tuple, docs.collect()))


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
