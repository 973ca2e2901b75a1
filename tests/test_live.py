"""The rolling thread list against filtering all messages, at many seconds."""

import os
import random

import pytest
from pyspark.sql import functions as F

from feedfold.streaming import feeds, live

ROW = "account_id int, seq bigint, timestamp bigint, chat_id string, chat_name string, text string, sender string, ts timestamp"
START = 1_700_000_000


def brute(messages, as_of, hours, by_account):
    threads = {}
    for m in messages:
        account, seq, second, chat, name, text = m
        if second is not None and as_of - hours * 3600 < second <= as_of:
            threads.setdefault((account if by_account else None, chat or name), []).append(m)
    out = []
    for (account, thread), rows in threads.items():
        first, last = min(rows, key=lambda m: m[1]), max(rows, key=lambda m: (m[2], m[1]))
        out.append((account, thread, first[4], len(rows), last[5], last[2], first[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("hours, shares, by", [(48, 16, ["account_id"]), (2, 1, [])])
def test_every_second_over_several_batches(spark, tmp_path, hours, shares, by):
    rnd = random.Random(hours)
    messages = []
    for i in range(900):
        second = START + i * 260 + rnd.randrange(-1700, 1700) + (40 * 3600 if i > 600 else 0)  # a gap of 40 hours
        second -= second % rnd.choice([1, 1, 60, 3600])
        chat = rnd.choice(["hot", "hot", "hot", "a", "", "b"])
        messages.append((rnd.randrange(2), rnd.choice([i, 5_000 - i]) * 10 + i % 10, second, chat, rnd.choice(["x", "y", "z"]),
                         rnd.choice([None, "", f"text {i}"])))
    messages = list({m[1]: m for m in messages}.values())
    messages.insert(50, (0, 99_999, None, "a", "x", "no time"))
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(source)
    stream = feeds.refresh_stream(spark, source, ROW, files_per_trigger=1)
    changes = live.stream_live_threads(stream, delay="2 hours", window_hours=hours, by=by, shares=shares)
    for part in range(3):
        df = spark.createDataFrame([(*m, "") for m in messages[part * 300 : (part + 1) * 300]], ROW.rpartition(",")[0]).withColumn("ts", F.timestamp_seconds("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        if part:  # two runs, the second of them with two batches and the state of the first
            feeds.append_to_table(changes, out, state, available_now=True).awaitTermination()
    table = spark.read.schema(changes.schema).parquet(out).cache()
    known = [m for m in messages if m[2] is not None]
    end = max(m[2] for m in known) - 2 * 3600 - 2
    some = rnd.sample(known, 3)
    moments = [START, some[0][2], some[1][2] + hours * 3600 - 1, some[1][2] + hours * 3600, some[2][2] - 1, START + 90_061, START + 250_000, end]
    for as_of in moments:
        as_of = min(as_of, end)
        got = live.threads_at(table, F.timestamp_seconds(F.lit(as_of)), hours, by).collect()
        rows = sorted(((r.account_id if by else None, r.thread_id, r.title, r.message_count, r.last_message, r.last_ts, r.first_seq) for r in got), key=str)
        assert rows == brute(known, as_of, hours, bool(by)), as_of - START


def test_state_follows_cells_and_not_threads(spark, tmp_path):
    """A key of the state for each share of a thread costs calls for each; 3,000 threads of one message are 64 keys of a few rows."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(source)
    start = START // 3600 * 3600
    messages = [(0, i, start + i, f"t{i}", "x", f"text {i}", "") for i in range(3_000)] + [(0, 9_000, start + 20_000, "end", "x", "", "")]
    for part in (messages[:3_000], messages[3_000:]):
        df = spark.createDataFrame(part, ROW.rpartition(",")[0]).withColumn("ts", F.timestamp_seconds("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
    with live.state_store(spark):
        query = feeds.append_to_table(live.stream_live_threads(feeds.refresh_stream(spark, source, ROW, 1)), out, state, available_now=True)
        query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 1_000
    table = spark.read.parquet(out)
    got = live.threads_at(table, F.timestamp_seconds(F.lit(start + 1_999))).agg(F.count("*"), F.sum("message_count"), F.max("first_seq")).first()
    assert tuple(got) == (2_000, 2_000, 1_999)
