"""The corpus pipeline: each stage works on all that the one before kept, read back from a written table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedfold.llm import bpe, catalog, decontaminate, minhash, substrings, toxicity
from feedfold.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network finds toxic (score of 0.5 or more) go; it learns from the stage's labelled rows."""
    return toxicity.reject(docs, toxicity.fitted(docs, catalog.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays: the one with the least id."""
    return minhash.keep_one_of_each(docs, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that start earlier in the corpus go; a text that loses none stays as it is, to the last space."""
    found = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("rest.text"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("rest.n_chars"))
    own = {"text": text, "n_chars": n_chars}
    return found.select(*[own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the question and the answer of a benchmark item go."""
    return decontaminate.decontaminated(docs, catalog.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts, and whether they decode to the bytes that were encoded (text null: no bytes)."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN).select("rest.doc_id", "rest.lang", "rest.source", "rest.text_sha256", "ids")
    return bpe.decode(coded, path).select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                                          (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", tokenize),
]

ORACLE_SQL = None  # a trained network and rank merges are not SQL; the stages are tested against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
