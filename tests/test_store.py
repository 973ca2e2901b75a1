import datetime as dt
import os
import random
import re
import threading
from unittest import mock

import pytest
from pyspark.sql import functions as F

from feedfold.entities import SUMMARY
from feedfold.operators import summaries as ops
from feedfold.sources import commits
from feedfold.sources.store import SummaryStore

T = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
NEW = "seq bigint, email_id string, subject string, sender string, email_date string, body string, summary string, model_used string, created_at timestamp"


def stored(rows, *pairs):
    return rows(SUMMARY, *[(i, key, None, None, None, None, f"old {key}", "m", T) for i, key in pairs])


def new(rows, *pairs):
    return rows(NEW, *[(seq, key, None, None, None, None, f"new {key} {seq}", "m", T) for seq, key in pairs])


def content(df):
    return sorted((r.id, r.email_id, r.summary) for r in df.collect())


def test_insert(rows):
    base = stored(rows, (3, "a"))
    assert content(ops.insert_summaries(base, new(rows, (0, "b"), (1, None), (2, None)))) == [
        (3, "a", "old a"), (4, "b", "new b 0"), (5, None, "new None 1"), (6, None, "new None 2")]
    with pytest.raises(ValueError, match="not unique: a"):
        ops.insert_summaries(base, new(rows, (0, "a")))
    with pytest.raises(ValueError, match="not unique: z"):
        ops.insert_summaries(base, new(rows, (0, "z"), (1, "z")))


def test_upsert_gives_a_replaced_row_a_new_id(rows):
    base = stored(rows, (1, "a"), (2, "b"), (3, None))
    got = content(ops.upsert_summaries(base, new(rows, (10, "a"), (11, "c"), (12, None), (13, "a"))))
    # The row with seq 10 used up id 4 before it was replaced itself.
    assert got == [(2, "b", "old b"), (3, None, "old None"), (5, "c", "new c 11"), (6, None, "new None 12"), (7, "a", "new a 13")]
    assert content(ops.upsert_summaries(stored(rows), new(rows, (5, "a")))) == [(1, "a", "new a 5")]


def test_delete_and_clear(rows):
    base = stored(rows, (1, "a"), (2, "b"))
    assert content(ops.delete_summaries(base, rows("id bigint", (1,), (99,)))) == [(2, "b", "old b")]
    empty = ops.clear_summaries(base)
    assert empty.count() == 0 and empty.columns == base.columns


def test_store_versions(spark, rows, tmp_path):
    store = SummaryStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0 and store.last_id() == 0
    store.insert(new(rows, (0, "a"), (1, "b")))
    assert content(store.read()) == [(1, "a", "new a 0"), (2, "b", "new b 1")]
    with pytest.raises(ValueError):
        store.insert(new(rows, (0, "a")))
    store.upsert(new(rows, (7, "a")), "t1")
    store.upsert(new(rows, (8, "a")), "t1")  # same tag: already done
    assert content(store.read()) == [(2, "b", "new b 1"), (3, "a", "new a 7")]
    store.delete(rows("id bigint", (3,)))
    assert content(store.read()) == [(2, "b", "new b 1")]
    store.upsert(new(rows, (0, "c")))  # id 3 is not used again
    assert content(store.read()) == [(2, "b", "new b 1"), (4, "c", "new c 0")]
    before = content(store.read())
    store.compact()
    assert content(store.read()) == before
    store.clear()
    assert store.read().count() == 0 and store.last_id() == 4


def test_folders_without_an_entry_do_not_count(spark, rows, tmp_path):
    store = SummaryStore(spark, str(tmp_path / "store"))
    store.write(stored(rows, (1, "a")))
    held = store.read()
    store.upsert(new(rows, (0, "b")), "t")
    os.remove(tmp_path / "store" / "log" / f"{2:012d}.json")
    assert content(store.read()) == content(held) == [(1, "a", "old a")]
    store.upsert(new(rows, (0, "b")), "t")
    assert content(store.read()) == [(1, "a", "old a"), (2, "b", "new b 0")]


def test_success_markers_are_not_needed(spark, rows, tmp_path):
    spark.conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        store = SummaryStore(spark, str(tmp_path / "store"))
        store.upsert(new(rows, (0, "a")))
        assert content(store.read()) == [(1, "a", "new a 0")]
    finally:
        spark.conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")


def test_two_writers_lose_nothing(spark, rows, tmp_path):
    """Both look at the same version before either has written; ids and rows of both are kept."""
    one, two = (SummaryStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.write(stored(rows, (1, "a")))
    before, looks = one._latest(), []
    fresh = SummaryStore._latest
    two._latest = lambda: before if not looks.append(0) and len(looks) <= 2 else fresh(two)
    one.upsert(new(rows, (0, "c"), (1, "a")))
    two.upsert(new(rows, (0, "d"), (1, "a")))
    assert len(looks) > 2
    assert content(one.read()) == [(2, "c", "new c 0"), (4, "d", "new d 0"), (5, "a", "new a 1")]
    # An insert looks again whether its keys are free.
    looks.clear()
    before = one._latest()
    one.insert(new(rows, (0, "e")))
    with pytest.raises(ValueError, match="not unique: e"):
        two.insert(new(rows, (0, "e")))


def test_a_compaction_gives_way_to_a_change(spark, rows, tmp_path):
    store = SummaryStore(spark, str(tmp_path / "store"))
    store.upsert(new(rows, (0, "a")))
    store.upsert(new(rows, (0, "b")))
    late = SummaryStore(spark, store.path)
    full = late._data(late.read())
    number = late._latest()["number"]
    store.upsert(new(rows, (0, "c")))
    assert not late._full(full, on=number)
    assert late.compact() and [kind for kind, *_ in late._latest()["live"]] == ["full"]
    assert content(store.read()) == [(1, "a", "new a 0"), (2, "b", "new b 0"), (3, "c", "new c 0")]


def test_deletes_write_ids_only_and_changes_are_folded(spark, rows, tmp_path, monkeypatch):
    from feedfold.sources import store as module
    monkeypatch.setattr(module, "MOST_FOLDERS", 4)
    store = SummaryStore(spark, str(tmp_path / "store"))
    store.write(stored(rows, (1, "a"), (2, "b"), (3, "c")))
    store.delete(rows("id bigint", (2,), (77,)))
    kind, folder, _ = store._latest()["live"][-1]
    assert kind == "delete" and spark.read.parquet(f"{store.path}/{folder}").columns == ["id"]
    for n in range(8):
        store.upsert(new(rows, (0, f"k{n % 3}")))
        assert len(store._latest()["live"]) <= 4
    assert [k for _, k, _ in content(store.read())] == ["a", "c", "k2", "k0", "k1"]
    assert store.last_id() == 11
    kept = content(store.read())
    assert store.remove_old(hours=1) == 0
    assert store.remove_old(hours=-1) > 3 and content(store.read()) == kept and store.last_id() == 11
    live = {f.split("/")[1] for _, f, _ in store._latest()["live"]}
    assert set(os.listdir(tmp_path / "store" / "data")) == live


ACCOUNTS = {"account_id": "bigint"}


def test_accounts_do_not_share_mails(spark, rows, tmp_path):
    by = list(ACCOUNTS)
    store = SummaryStore(spark, str(tmp_path / "store"), ACCOUNTS)
    both = new(rows, (0, "a"), (1, "b")).withColumn("account_id", F.lit(1).cast("bigint")).unionByName(
        new(rows, (2, "a")).withColumn("account_id", F.lit(2).cast("bigint")))
    store.insert(both)
    key = lambda df: sorted((r.account_id, r.email_id, r.summary) for r in df.collect())
    assert key(store.read()) == [(1, "a", "new a 0"), (1, "b", "new b 1"), (2, "a", "new a 2")]
    store.upsert(new(rows, (9, "a")).withColumn("account_id", F.lit(2).cast("bigint")))
    assert key(store.read()) == [(1, "a", "new a 0"), (1, "b", "new b 1"), (2, "a", "new a 9")]
    asked = rows("account_id bigint, id string", (1, "a"), (2, "a"), (2, "b"), (3, "a"))
    found = {(r.account_id, r.id): r.has_summary for r in ops.with_has_summary(asked, store.read(), by).collect()}
    assert found == {(1, "a"): True, (2, "a"): True, (2, "b"): False, (3, "a"): False}
    requests = asked.withColumnRenamed("id", "email_id")
    assert {(r.account_id, r.email_id): r.summary for r in ops.cache_lookup(requests, store.read(), by).collect()} == {
        (1, "a"): "new a 0", (2, "a"): "new a 9", (2, "b"): None, (3, "a"): None}
    assert sorted((r.account_id, r.email_id) for r in ops.cache_misses(requests, store.read(), by).collect()) == [(2, "b"), (3, "a")]
    assert [r.account_id for r in ops.select_by_id(asked, asked.where("account_id = 2"), by).distinct().collect()] == [2, 2]
    ids = store.read().select("account_id", "id")
    assert ops.delete_summaries(store.read(), ids.withColumn("account_id", F.lit(2).cast("bigint")), by).count() == 2


def test_look_ups(rows):
    base = stored(rows, (1, "a"), (2, ""), (3, None), (4, None))
    mails = rows("n int, id string", (0, "a"), (1, "x"), (2, None), (3, ""))
    flags = {r.n: r.has_summary for r in ops.with_has_summary(mails, base).collect()}
    assert flags == {0: True, 1: False, 2: True, 3: True}
    requests = mails.withColumnRenamed("id", "email_id")
    found = {r.n: (r.summary, r.cached) for r in ops.cache_lookup(requests, base).collect()}
    assert found == {0: ("old a", True), 1: (None, False), 2: (None, False), 3: ("old ", True)}
    assert sorted(r.n for r in ops.cache_misses(requests, base).collect()) == [1, 2]
    assert [r.n for r in ops.select_by_id(mails, rows("id string", ("a",), (None,))).collect()] == [0]


def test_priority_union(rows):
    lists = [rows("seq bigint, value string", (0, "a"), (1, "b")),
             rows("seq bigint, value string", (0, " b "), (1, ""), (2, " c"), (3, "c"))]
    def merged(current):
        df = ops.priority_union(lists, rows("seq bigint, value string", (0, current)))
        return [r.value for r in df.orderBy("priority", "seq").collect()]
    assert merged("x") == ["x", "a", "b", "c"]
    assert merged("c") == ["a", "b", "c"]
    assert merged("") == ["a", "b", "c"]
    assert [r.value for r in ops.priority_union(lists).orderBy("priority", "seq").collect()] == ["a", "b", "c"]


def test_many_requests_without_id_and_one_hot_id(spark, rows):
    df = spark.range(9000).selectExpr("id as n", "case id % 3 when 0 then null when 1 then 'hot' else cast(id as string) end as email_id")
    found = ops.cache_lookup(df, stored(rows, (1, "hot"), (2, "5")))
    assert found.where("cached").count() == 3001
    assert found.count() == 9000
    assert found.where(F.col("email_id").isNull()).count() == 3000


def test_a_tag_is_never_forgotten(spark, rows, tmp_path, monkeypatch):
    """Also when more tags than the log remembers came in between."""
    monkeypatch.setattr("feedfold.sources.store.MOST_TAGS", 2)
    store = SummaryStore(spark, str(tmp_path / "store"))
    for i in range(5):
        store.upsert(new(rows, (8, f"k{i}")), f"tag/{i}")
    before = sorted(store.read().collect())
    assert len(before) == 5
    store.upsert(new(rows, (8, "k0")), "tag/0")
    assert sorted(store.read().collect()) == before


def test_an_entry_that_was_not_settled_is_settled_once(spark, rows, tmp_path, monkeypatch):
    """A writer is lost after its entry; two others with the same tag finish it, with the rows of the first."""
    store = SummaryStore(spark, str(tmp_path / "store"))
    settle = SummaryStore.settle
    monkeypatch.setattr(SummaryStore, "settle", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.upsert(new(rows, (8, "first")), "t")
    assert store.read().count() == 0
    monkeypatch.setattr(SummaryStore, "settle", settle)
    for _ in range(2):
        store.upsert(new(rows, (8, "second")), "t")
    assert [r.email_id for r in store.read().collect()] == ["first"]


def buckets(df):
    return {int(m[1]) for f in df.inputFiles() if (m := re.search(r"bucket=(\d+)/", f))}


def test_a_look_up_opens_only_buckets_that_it_can_meet(spark, rows, tmp_path):
    store = SummaryStore(spark, str(tmp_path / "store"), buckets=32)
    store.write(stored(rows, *[(i, f"k{i:03d}") for i in range(300)], (300, None)))
    store.upsert(new(rows, (0, "k007"), (1, "z"), (2, None)))
    store.delete(rows("id bigint", (9,)))
    assert len(buckets(store.read())) == 32
    asked = rows("email_id string", ("k007",), ("k009",), ("k011",), ("nowhere",), (None,))
    found = store.read_for(asked)
    assert 1 <= len(buckets(found)) <= 4
    wanted = {"k007", "k009", "k011", "nowhere"}
    pick = lambda df: sorted((r.id, r.email_id, r.summary) for r in df.where(F.col("email_id").isin(*wanted)).collect())
    assert pick(found) == pick(store.read()) == [(11, "k011", "old k011"), (301, "k007", "new k007 0")]
    # Many keys meet every bucket, none meets none; an empty batch of keys opens nothing.
    many = spark.range(300).selectExpr("format_string('k%03d', id) as email_id")
    assert len(buckets(store.read_for(many))) == 32
    assert sorted(r.id for r in store.read_for(many).collect()) == [i for i in range(300) if i not in (7, 9)] + [301]
    assert store.read_for(asked.where("false")).collect() == [] and buckets(store.read_for(asked.where("false"))) == set()


def test_a_look_up_reads_no_row_group_without_its_key(spark, rows, tmp_path):
    """The key lies between others, so that only the filters can tell that it is in none of the deltas."""
    store = SummaryStore(spark, str(tmp_path / "store"))
    for n in range(3):
        store.upsert(new(rows, *[(i, f"k{n}{i:04d}x") for i in range(500)]))

    def read(df):
        df.collect()
        plan, seen = [df._jdf.queryExecution().executedPlan()], 0
        while plan:
            node = plan.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                plan.append(node.executedPlan())
                continue
            if node.nodeName().endswith("QueryStage"):
                plan.append(node.plan())
                continue
            if node.nodeName().startswith("Scan parquet"):
                seen += node.metrics().apply("numOutputRows").value()
            children = node.children()
            plan += [children.apply(i) for i in range(children.size())]
        return seen

    assert read(store.read()) >= 1500
    assert read(store.read_for(rows("email_id string", ("k10007y",)))) == 0
    found = store.read_for(rows("email_id string", ("k10007x",)))
    assert read(found) <= 500 * 2 and [r.email_id for r in found.collect()] == ["k10007x"]  # keyed rows and rows without key


def test_accounts_have_their_own_buckets(spark, rows, tmp_path):
    store = SummaryStore(spark, str(tmp_path / "store"), ACCOUNTS, buckets=8)
    table = spark.range(60).selectExpr("id div 2 as n", "1 + id % 2 as account_id", "id as seq").selectExpr(
        "account_id", "seq", "concat('k', n) as email_id", *[f"cast(null as string) as {c}" for c in ("subject", "sender", "email_date", "body")],
        "concat(account_id, ':', n) as summary", "'m' as model_used", "timestamp'2024-01-01' as created_at")
    store.insert(table)
    assert store.compact()
    # The account's type may be another than the store's.
    asked = rows("account_id int, email_id string", (1, "k3"), (2, "k4"), (3, "k3"))
    found = ops.cache_lookup(asked, store.read_for(asked), list(ACCOUNTS))
    assert sorted((r.account_id, r.email_id, r.summary) for r in found.collect()) == [(1, "k3", "1:3"), (2, "k4", "2:4"), (3, "k3", None)]
    assert len(buckets(store.read_for(asked))) <= 3
    with pytest.raises(ValueError, match="not unique: k3"):
        store.insert(table.where("email_id = 'k3'"))


def test_folding_leaves_other_buckets_where_they_are(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr("feedfold.sources.store.MOST_FOLDERS", 8)
    store = SummaryStore(spark, str(tmp_path / "store"), buckets=16)
    store.write(stored(rows, *[(i, f"k{i}") for i in range(100)]))
    before = set(store.read().inputFiles())
    for n in range(8):
        store.upsert(new(rows, (0, "k5")))
    live = store._latest()["live"]
    assert [kind for kind, *_ in live] == ["full", "full"]
    after = set(store.read().inputFiles())
    assert len(after & before) == 15 and len(after - before) == 1
    assert [(i, k) for i, k, _ in content(store.read())] == [(i, f"k{i}") for i in range(100) if i != 5] + [(107, "k5")]
    kept = content(store.read())
    assert store.remove_old(hours=-1) > 0 and content(store.read()) == kept


def test_random_changes_against_a_dictionary(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr("feedfold.sources.store.MOST_FOLDERS", 5)
    store, dice = SummaryStore(spark, str(tmp_path / "store"), buckets=4), random.Random(3)
    expected, last = {}, 0
    for step in range(22):
        kind = dice.choice(["upsert", "upsert", "upsert", "delete", "compact"])
        if kind == "upsert":
            keys = [dice.choice(["a", "b", "c", "d", "e", "f", "", None]) for _ in range(dice.randint(1, 4))]
            store.upsert(new(rows, *enumerate(keys)))
            for seq, key in enumerate(keys):
                expected = {i: row for i, row in expected.items() if key is None or row[0] != key}
                expected[last + 1 + seq] = (key, f"new {key} {seq}")
            last += len(keys)
        elif kind == "delete" and expected:
            gone = dice.choice(list(expected))
            store.delete(rows("id bigint", (gone,)))
            del expected[gone]
        else:
            store.compact()
        if step % 4 == 1:
            assert sorted((r.id, r.email_id, r.summary) for r in store.read().select("id", "email_id", "summary").collect()) == sorted(
                (i, *row) for i, row in expected.items()), (step, kind)
    asked = rows("email_id string", ("a",), ("",))
    found = {(r.id, r.email_id) for r in store.read_for(asked).where("email_id in ('a', '')").collect()}
    assert found == {(i, row[0]) for i, row in expected.items() if row[0] in ("a", "")}


def test_two_writers_on_a_store_whose_rename_copies(spark, rows, tmp_path):
    """Objects appear whole or not at all and are created on condition; nothing is renamed."""
    lock, made = threading.Lock(), []

    def create(name, content):
        with lock:
            if os.path.exists(name):
                return False
            os.makedirs(os.path.dirname(name), exist_ok=True)
            with open(name, "xb") as out:
                out.write(content)
            made.append(name)
            return True

    stores = [SummaryStore(spark, str(tmp_path / "store"), create=create) for _ in range(2)]
    frames = [[new(rows, (0, f"{w}{n}"), (1, "both")) for n in range(3)] for w in range(2)]
    writers = [threading.Thread(target=lambda w=w: [stores[w].upsert(f) for f in frames[w]]) for w in range(2)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    got = content(stores[0].read())
    assert sorted(k for _, k, _ in got) == ["00", "01", "02", "10", "11", "12", "both"]
    assert stores[0].last_id() == 12 and len({i for i, *_ in got}) == 7
    assert len(made) == len(set(made)) == 6 and not [f for f in os.listdir(tmp_path / "store" / "log") if "draft" in f]


def test_files_are_made_exclusively(spark, tmp_path):
    ways = {"linked": commits._linked, "created": commits._conditional(None)}
    for name, way in ways.items():
        path = str(tmp_path / name / "1.json")
        assert commits._made(spark, way, path, b"one") and not commits._made(spark, way, path, b"two")
        assert open(path, "rb").read() == b"one"
        assert [f for f in os.listdir(tmp_path / name) if not f.endswith(".crc")] == ["1.json"]
    # A file system that does not know the condition refuses; nothing is written then.
    with pytest.raises(Exception, match="(?i)unknown|mandatory|condition"):
        commits._made(spark, commits._conditional(commits.CREATED["s3a"]), str(tmp_path / "other.json"), b"one")
    assert not os.path.exists(tmp_path / "other.json")


def test_an_answer_that_was_lost_is_looked_up(spark, tmp_path):
    def lost(spark, fs, path, content):
        commits._linked(spark, fs, path, content)
        fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.none"))  # fails after the file was made
    path = str(tmp_path / "log" / "1.json")
    assert commits._made(spark, lost, path, b"mine") and not commits._made(spark, lost, path, b"other")


def test_an_unknown_file_system_needs_a_function():
    spark = mock.MagicMock()
    spark._jvm.org.apache.hadoop.fs.Path.return_value.getFileSystem.return_value.getUri.return_value.getScheme.return_value = "viewed"
    with pytest.raises(ValueError, match="viewed"):
        commits.creator(spark, "viewed://x")
