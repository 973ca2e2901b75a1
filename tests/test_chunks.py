import os
import threading

import pytest
from pyspark.sql import functions as F

from feedfold.operators.generation import generate, spread_calls
from feedfold.plans import chunks, summarize
from feedfold.plans.chunks import in_chunks
from feedfold.sources.store import SummaryStore

REQUESTS = "seq bigint, email_id string, subject string, sender string, email_date string, body string"


def counting(folder, lost=False):
    """A model that notes each prompt as a file of its own."""
    os.makedirs(folder, exist_ok=True)

    def load():
        import uuid

        def model(prompts, budgets):
            for p in prompts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                    out.write(p)
            return [f"Said to {len(p)}" for p in prompts]
        return model
    return load


def calls(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def prompts(spark, n):
    return spark.range(n).select(F.col("id").alias("seq"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))


def test_a_job_that_was_lost_asks_only_for_the_rest(spark, tmp_path, monkeypatch):
    noted, path = str(tmp_path / "calls"), str(tmp_path / "job")
    make = lambda rows: generate(spread_calls(rows, "seq"), counting(noted))
    finish, turns = chunks._Job.finish, []

    def lost(self, chunk, *rest):
        if len(turns) == 2:
            raise RuntimeError("lost")
        turns.append(chunk)
        finish(self, chunk, *rest)

    monkeypatch.setattr(chunks._Job, "finish", lost)
    with pytest.raises(RuntimeError, match="lost"):
        in_chunks(prompts(spark, 60), ["seq"], path, make, chunk_rows=12, writer="me", at_once=1)
    half = len(calls(noted))
    assert 0 < half < 60
    monkeypatch.setattr(chunks._Job, "finish", finish)
    # The rows are those of the first run, whatever is asked now.
    got = in_chunks(prompts(spark, 3), ["seq"], path, make, chunk_rows=1, writer="me")
    assert sorted((r.seq, r.answer) for r in got.collect()) == [(i, f"Said to {len(f'p{i}')}") for i in range(60)]
    assert calls(noted) == sorted(f"p{i}" for i in range(60))
    assert in_chunks(prompts(spark, 60), ["seq"], path, make).count() == 60 and len(calls(noted)) == 60


def test_a_chunk_lost_after_its_calls_is_made_again_and_counts_once(spark, tmp_path, monkeypatch):
    noted, path = str(tmp_path / "calls"), str(tmp_path / "job")
    make = lambda rows: generate(rows, counting(noted))
    enter = chunks._Job.enter
    monkeypatch.setattr(chunks._Job, "enter", lambda self, name, **entry: enter(self, name, **entry) if "done" not in name else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        in_chunks(prompts(spark, 5), ["seq"], path, make, writer="me")
    monkeypatch.setattr(chunks._Job, "enter", enter)
    assert in_chunks(prompts(spark, 5), ["seq"], path, make, writer="me").count() == 5
    assert len(calls(noted)) == 10


def test_two_runs_share_the_chunks(spark, tmp_path):
    noted, path = str(tmp_path / "calls"), str(tmp_path / "job")
    make = lambda rows: generate(rows, counting(noted))
    found = [None, None]

    def run(i):
        found[i] = sorted(r.seq for r in in_chunks(prompts(spark, 40), ["seq"], path, make, chunk_rows=10, at_once=1).collect())

    runs = [threading.Thread(target=run, args=(i,)) for i in range(2)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert found == [list(range(40))] * 2 and calls(noted) == sorted(f"p{i}" for i in range(40))


def test_a_claim_is_taken_over_after_its_lease(spark, tmp_path):
    noted, path = str(tmp_path / "calls"), str(tmp_path / "job")
    job = chunks._Job(spark, path, None, "dead", 3600)
    job.plan(prompts(spark, 4), ["seq"], 100)
    assert job.claimed(0)
    assert not chunks._Job(spark, path, None, "other", 3600).claimed(0)
    make = lambda rows: generate(rows, counting(noted))
    assert in_chunks(prompts(spark, 4), ["seq"], path, make, lease=0).count() == 4
    assert len(os.listdir(tmp_path / "job" / "claims" / "0")) >= 2


def test_no_rows(spark, tmp_path):
    got = in_chunks(prompts(spark, 0), ["seq"], str(tmp_path / "job"), lambda rows: generate(rows, counting(str(tmp_path / "calls"))))
    assert got.count() == 0 and got.columns == ["seq", "prompt", "answer"]


def test_summaries_in_chunks(spark, rows, tmp_path, monkeypatch):
    """Lost after the first chunk; the same tag finishes it, with no mail asked twice."""
    noted = str(tmp_path / "calls")
    store = SummaryStore(spark, str(tmp_path / "store"))
    asked = rows(REQUESTS, *[(i, f"m{i % 30}", "s", "x@y", "d", f"body {i % 30}") for i in range(40)], (40, None, "s", "x", "d", "no key"), (41, "bad", "s", "x", "d", ""))
    serve = lambda tag, n: summarize.summarize_emails(asked, store, {"m": counting(noted)}, 1_700_000_000, tag=tag, chunk_rows=n)
    with pytest.raises(ValueError, match="tag"):
        serve(None, 10)
    finish, turns = chunks._Job.finish, []

    def lost(self, chunk, *rest):
        if turns:
            raise RuntimeError("lost")
        turns.append(chunk)
        finish(self, chunk, *rest)

    monkeypatch.setattr(chunks._Job, "finish", lost)
    with pytest.raises(RuntimeError, match="lost"):
        serve("t", 8)
    assert store.read().count() == 0 and 0 < len(calls(noted)) < 31
    monkeypatch.setattr(chunks._Job, "finish", finish)
    first = sorted(map(tuple, serve("t", 8).collect()), key=str)
    assert len(calls(noted)) == 31 == len(set(calls(noted)))
    assert store.read().count() == 31 and len(first) == 42
    plain = SummaryStore(spark, str(tmp_path / "plain"))
    other = summarize.summarize_emails(asked, plain, {"m": counting(str(tmp_path / "other"))}, 1_700_000_000, tag="t")
    assert sorted(map(tuple, other.collect()), key=str) == first
    assert sorted(map(tuple, serve("t", 8).collect()), key=str) == first and len(calls(noted)) == 31
