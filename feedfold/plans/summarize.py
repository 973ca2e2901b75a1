"""Summaries of mails through the summary table, and of single items."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .. import fixed
from ..columns import Instant, instant, quoted
from ..functions.fields import non_blank
from ..functions.prompts import email_prompt, item_prompt
from ..functions.text import strip_code_blocks
from ..operators.filters import check_requests
from ..operators.generation import Loader, generate_with_fallback, spread_calls
from ..operators.joins import fresh_key
from ..operators.ranking import arrival_numbers
from ..operators.summaries import STORED, cache_misses
from ..session import scratch_path
from ..sources.store import BLOOM, SummaryStore
from .chunks import CHUNK_ROWS, in_chunks

RESULT = ("seq", "email_id", "summary", "model_used", "cached", "error")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: made once, read by all that follow."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def generate_misses(misses: DataFrame, models: Mapping[str, Loader],
                    chosen: str | None = None) -> DataFrame:
    """Summaries for requests that have none; a failed row keeps its error."""
    asked = misses.drop("error").withColumn("prompt", email_prompt())
    return generate_with_fallback(asked, models, chosen=chosen, output="summary").drop("prompt")


def summarize_emails(requests: DataFrame, store: SummaryStore, models: Mapping[str, Loader],
                     as_of: Instant, chosen: str | None = None, tag: str | None = None, chunk_rows: int | None = None) -> DataFrame:
    """Serve requests (the store's account columns, ``seq, email_id, subject, sender, email_date, body``).

    Stored summaries are returned as they are.  Each missing mail is summarised
    once, written to the store and then returned; a later request for the same
    mail in the batch finds it there.  Results have the account columns and ``RESULT``.

    Which requests are the first for their mail is decided on keys alone, combined on the map side.
    Bodies of those few are then moved once, straight to the tasks that call the
    models, and written once: as the delta of the store, so the models are not called
    again, also when executors are lost later.

    With a ``tag`` the results are written beside the store and entered in its ledger before the store changes; the
    same tag again gives the same rows, ``cached`` and ``model_used`` included, and finishes what was left undone.
    Other requests under that tag (another set of ``seq`` and ``email_id``) are a batch without a tag.

    With a ``tag`` and ``chunk_rows`` the models are called in chunks of about so many mails (``plans.chunks``, in the store's
    folder ``jobs``).  A run that was lost, repeated with its tag, asks for the mails of unfinished chunks only.
    """
    if chunk_rows and not tag:
        raise ValueError("chunks are found again by their tag")
    asked = _fingerprint(requests, store) if tag else None
    entry = store.entered(tag) if tag else None
    if tag and (entry is None or entry["asked"] == asked):
        if entry is None:
            served, folder, ids = _served(requests, store, models, as_of, chosen, chunk_rows and _job(store, tag, asked), chunk_rows)
            results = f"results/{uuid.uuid4().hex}"
            served.write.parquet(f"{store.path}/{results}")
            entry = store.enter(tag, {"folder": folder, "ids": ids, "results": results, "schema": served.schema.json(),
                                      "asked": asked})
        store.settle(tag, entry)
        kinds = StructType.fromJson(json.loads(entry["schema"]))
        return store.spark.read.schema(kinds).parquet(f"{store.path}/{entry['results']}")
    served, folder, ids = _served(requests, store, models, as_of, chosen)
    if folder:
        store.add(folder, ids)
    return served


def _fingerprint(requests: DataFrame, store: SummaryStore) -> list[str]:
    key = F.xxhash64(*(quoted(c) for c in store.by), "seq", "email_id").cast("decimal(38,0)")
    return [str(x) for x in requests.agg(F.count(F.lit(1)), F.sum(key)).first()]


def _job(store: SummaryStore, tag: str, asked: list[str]) -> str:
    return f"{store.path}/jobs/{quote(tag, safe='')}-{'-'.join(asked)}"


def _served(requests: DataFrame, store: SummaryStore, models: Mapping[str, Loader], as_of: Instant,
            chosen: str | None, job: str | None = None, chunk_rows: int | None = None) -> tuple[DataFrame, str | None, int]:
    """The results; the folder of new summaries, which is no part of the store yet (None: there are none), and its ids."""
    by = store.by
    checked = check_requests(requests, "email_summary")
    valid = checked.where(F.col("error").isNull())
    # The version of the store as it is now, as far as these mails go; what is added below is not part of it.
    stored = store.read_for(valid)

    misses = cache_misses(valid.select(*by, "seq", "email_id"), stored, by)
    first = misses.where(F.col("email_id").isNotNull()).groupBy(*by, "email_id").agg(F.min("seq").alias("seq"))
    asked = first.select("seq").unionByName(misses.where(F.col("email_id").isNull()).select("seq"))
    asked = written(arrival_numbers(asked, "seq", "_nth"), "asked")
    size = asked.count()
    bodies = spread_calls(valid.join(asked, "seq"), "seq", rows=size)  # joined first, so that only their bodies are dealt
    if job:
        # What is missing may have changed since a lost run, if others write to the store; then it is another job.
        mark = asked.agg(F.sum(F.xxhash64("seq").cast("decimal(38,0)"))).first()[0]
        answers = in_chunks(bodies, ["seq"], f"{job}/{size}-{mark or 0}", lambda rows: generate_misses(spread_calls(rows, "seq"), models, chosen),
                            chunk_rows, writer=job)
    else:
        answers = generate_misses(bodies, models, chosen)
    made = answers.withColumns({
        "id": F.col("_nth"), "created_at": instant(as_of),
        "failed": F.col("error").isNotNull()})
    folder = f"data/{uuid.uuid4().hex}"
    columns = [*by, *STORED, "seq", "error", "failed"]
    made.select(*columns).write.options(**BLOOM).partitionBy("failed").parquet(f"{store.path}/{folder}")
    kinds = StructType([f for name in columns for f in made.schema if f.name == name])
    made = store.spark.read.schema(kinds).parquet(f"{store.path}/{folder}")
    new = None if made.where("not failed").isEmpty() else f"{folder}/failed=false"
    ids = size if new else 0

    # A key is in the store or was made, never both.
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    known = stored.select(
        *by, "email_id", "summary", no_text.alias("model_used"), no_text.alias("failure"), no_number.alias("maker")
    ).unionByName(made.select(
        *by, "email_id", "summary", "model_used", F.col("error").alias("failure"), F.col("seq").alias("maker")
    )).where(F.col("email_id").isNotNull()).withColumn("email_id", fresh_key("email_id"))
    known = known.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)} | {"email_id": "_key"})
    keys = checked.select(*by, "seq", "email_id", "error")
    same = F.col("email_id") == F.col("_key")
    for i, c in enumerate(by):
        same &= quoted(c).eqNullSafe(F.col(f"_by{i}"))
    own = F.coalesce(F.col("maker") == F.col("seq"), F.lit(False))
    usable = F.col("error").isNull()
    served = keys.where(F.col("email_id").isNotNull() | F.col("error").isNotNull()).join(known, same, "left").select(
        *by, "seq", "email_id",
        F.when(usable, F.col("summary")).alias("summary"),
        F.when(usable & own, F.col("model_used")).alias("model_used"),
        (usable & ~own & F.col("summary").isNotNull()).alias("cached"),
        F.coalesce("error", "failure").alias("error"),
    )
    without_key = made.where(F.col("email_id").isNull()).select(
        *by, "seq", "email_id", "summary", "model_used", F.lit(False).alias("cached"), "error"
    )
    return served.unionByName(without_key), new, ids


def summarize_items(requests: DataFrame, models: Mapping[str, Loader],
                    chosen: str | None = None) -> DataFrame:
    """Summaries of events, reminders and conversations (``kind, title, content``); not stored."""
    checked = check_requests(requests, "item_summary")
    good = checked.where(F.col("error").isNull()).drop("error")
    asked = spread_calls(good).withColumn("prompt", item_prompt())
    made = generate_with_fallback(asked, models, chosen=chosen, output="summary").drop("prompt", "error")
    made = made.withColumn("summary", non_blank(strip_code_blocks("summary"))).withColumn(
        "error", F.when(F.col("summary").isNull(), fixed.ERROR_SUMMARY)
    )
    bad = checked.where(F.col("error").isNotNull()).withColumns({
        "summary": F.lit(None).cast("string"), "model_used": F.lit(None).cast("string"),
    })
    return made.unionByName(bad)
