"""One account, key or id holds a third of all rows; results stay whole and plans stay spread."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedfold.entities import SUMMARY
from feedfold.operators import digest, ranking, summaries as ops, threads
from feedfold.plans.message_threads import message_threads
from feedfold.sources.message_tables import with_fallback

N = 30000


@pytest.fixture
def messages(spark):
    return spark.range(N).repartition(6).selectExpr(
        "id as seq", "case when id % 3 = 0 then 'hot' else concat('a', id % 50) end as account",
        "case when id % 2 = 0 then 'big' else cast(id % 200 as string) end as chat_id", "'' as chat_name", "'s' as sender",
        "'in' as direction", "'d' as date", "(id * 7919) % 30011 as timestamp", "concat('t', id) as text")


def python_rows():
    for i in range(N):
        yield (i, "hot" if i % 3 == 0 else f"a{i % 50}", "big" if i % 2 == 0 else str(i % 200), (i * 7919) % 30011)


def test_caps_and_rollup(messages):
    per_account = {}
    for seq, account, chat, ts in python_rows():
        per_account.setdefault(account, []).append((-ts, seq, chat))
    want = Counter()
    for account, found in per_account.items():
        for _, _, chat in sorted(found)[:100]:
            want[account, chat] += 1
    got = message_threads(messages, 40000, 12, 100, ["account"]).collect()
    assert {(r.account, r.thread_id): r.message_count for r in got} == dict(want)


@pytest.mark.parametrize("n", [50, 1000, 1001, 5000])
def test_caps_are_merged_in_two_levels_at_any_n(messages, n):
    got = ranking.newest_n(messages, n, ["account"], ts="timestamp")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(account") == 2
    per_account = {}
    for seq, account, _, ts in python_rows():
        per_account.setdefault(account, []).append((-ts, seq))
    want = {(account, seq, i + 1) for account, found in per_account.items() for i, (_, seq) in enumerate(sorted(found)[:n])}
    assert {(r.account, r.seq, r["rank"]) for r in got.collect()} == want
    assert ranking.newest_n(messages, n, ts="timestamp").count() == n


def test_every_cap_is_merged_in_two_levels(messages):
    rows = messages.withColumns({"due_ts": F.col("timestamp"), "start_ts": F.col("timestamp"), "chat_seq": F.col("seq") % 9})
    for cap in (ranking.cap_by_arrival, ranking.cap_then_sort, ranking.sort_then_cap, ranking.cap_across_groups):
        plan = cap(rows, 1001, ["account"])._jdf.queryExecution().executedPlan().toString()
        assert "_share" in plan, cap


def test_all_rows_are_ranked_in_spans(messages):
    rows = messages.selectExpr("account", "seq", "if(seq % 100 = 0, null, timestamp * 40) as start_ts")
    want = {}
    for r in rows.collect():
        want.setdefault(r.account, []).append(((r.start_ts is not None, r.start_ts or 0), r.seq))
    want = {(a, seq, i + 1) for a, found in want.items() for i, (_, seq) in enumerate(sorted(found))}
    got = ranking.sort_then_cap(rows, 0, ["account"])
    assert got.columns == ranking.sort_then_cap(rows, 3, ["account"]).columns
    assert {(r.account, r.seq, r["rank"]) for r in got.collect()} == want
    assert sorted(r["rank"] for r in ranking.sort_then_cap(rows, 0).collect()) == list(range(1, N + 1))


def test_uncapped_rollup_is_whole(messages):
    got = {r.thread_id: r.message_count for r in threads.thread_rollup(messages).collect()}
    assert got == dict(Counter(chat for _, _, chat, _ in python_rows()))
    plan = threads.thread_rollup(messages)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "partial_max_by" in plan


def test_counts_per_source(messages):
    got = digest.source_counts({"a": messages, "b": messages.where("account = 'hot'")}, ["account"])
    hot = got.where("account = 'hot'").first()
    assert (hot.n_a, hot.n_b) == (N // 3, N // 3)
    assert got.agg(F.sum("n_a")).first()[0] == N


def test_keep_first(messages):
    got = ranking.keep_first(messages.select("account", "timestamp", "seq"), ["account"], ["timestamp", "seq"])
    want = {}
    for seq, account, _, ts in python_rows():
        want[account] = min(want.get(account, (ts, seq)), (ts, seq))
    assert {r.account: (r.timestamp, r.seq) for r in got.collect()} == want


@pytest.fixture
def small_partitions(spark):
    """Limits under which these few rows count as skewed, and no broadcasts."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "12",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_are_split(spark, messages, small_partitions):
    store = messages.groupBy("account").agg(F.max("seq").alias("id")).selectExpr(
        "id", "account as email_id", "'' as subject", "'' as sender", "'' as email_date", "'' as body", "'s' as summary",
        "'m' as model_used", "timestamp'2024-01-01' as created_at")
    requests = messages.selectExpr("seq", "account as email_id", "text as body")
    for df, size in (
        (ops.cache_lookup(requests, store), N),
        (ops.cache_misses(requests, store.where("email_id <> 'hot'")), N // 3),
        (ops.with_has_summary(requests.withColumnRenamed("email_id", "id"), store), N),
    ):
        plan = final_plan(df)
        assert "skew=true" in plan
        assert df.count() == size
    # A side that was grouped before is shuffled again, in the shape that can be split; nothing is repeated.
    plan = final_plan(with_fallback(messages.where("account = 'a1'"), messages, ["account"]))
    assert "skew=true" in plan and "Generate" not in plan
    assert set(store.columns) == set(spark.createDataFrame([], SUMMARY).columns)


def test_fallback_of_a_hot_account(messages, small_partitions):
    primary = messages.where("account = 'a1'")
    assert with_fallback(primary, messages, ["account"]).count() == N
