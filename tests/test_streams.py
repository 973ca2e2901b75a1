import os

import pytest
from pyspark.sql import functions as F

from feedfold.entities import MESSAGE
from feedfold.operators.threads import thread_rollup
from feedfold.sources.store import SummaryStore
from feedfold.streaming import feeds as streams

ROW = "event_id bigint, ts timestamp, kind string"


class Landing:
    """A folder to which rows are delivered file by file."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, str(folder / "in"), 0
        self.out, self.state = str(folder / "out"), str(folder / "state")

    def deliver(self, df):
        df.coalesce(1).write.mode("append").parquet(self.folder)

    def stream(self, schema):
        return streams.refresh_stream(self.spark, self.folder, schema)


@pytest.fixture
def landing(spark, tmp_path):
    return Landing(spark, tmp_path)


def events(rows, *data):
    return rows("event_id bigint, t string, kind string", *data).select(
        "event_id", F.to_timestamp("t").alias("ts"), "kind")


def step(query):
    query.awaitTermination()


def seen(spark, path):
    return sorted(r.event_id for r in spark.read.parquet(path).collect())


def test_rows_are_read_once_and_repeats_dropped(spark, rows, landing):
    first = events(rows, (1, "2024-01-10 00:00:00", "a"), (2, "2024-01-10 01:00:00", "a"))
    landing.deliver(first)
    run = lambda: step(streams.append_to_table(
        streams.stream_dedup(landing.stream(ROW), ["event_id"]), landing.out, landing.state, available_now=True))
    run()
    landing.deliver(first.unionByName(events(rows, (3, "2024-01-10 02:00:00", "b"))))
    run()
    assert seen(spark, landing.out) == [1, 2, 3]


def test_late_rows_go_and_future_rows_show_up_when_due(spark, rows, landing):
    run = lambda: step(streams.append_to_table(streams.stream_dedup(
        streams.drop_late(landing.stream(ROW), as_of="2024-01-20 00:00:00"), ["event_id"], delay=None),
        landing.out, landing.state, available_now=True))
    landing.deliver(events(rows, (1, "2024-01-19 00:00:00", "a"), (2, "2024-01-21 00:00:00", "future"), (5, "2024-03-01 00:00:00", "far")))
    run()
    # The far row has not moved the watermark: what is in time stays in time.
    landing.deliver(events(rows, (3, "2024-01-18 06:00:00", "in time"), (4, "2024-01-16 00:00:00", "late"), (2, "2024-01-21 00:00:00", "again")))
    run()
    landed = spark.read.parquet(landing.out)
    assert sorted(r.event_id for r in landed.collect()) == [1, 2, 3, 5]
    at = lambda day: sorted(r.event_id for r in streams.due_rows(landed, f"2024-{day} 00:00:00").collect())
    assert at("01-20") == [1, 3] and at("01-21") == [2] and at("01-22") == [2] and at("03-01") == [5]


def chats(rows, *data):
    return rows(MESSAGE, *data).withColumn("ts", F.timestamp_seconds("timestamp"))


def test_stream_threads_equal_the_batch_result(spark, rows, landing):
    df = chats(rows, *[(i, f"c{i % 3}", f"n{i % 2}", "s", "in", "", 3_600 * i + (i * 7) % 20, f"t{i}") for i in range(30)])
    for part in (df.where("seq < 10"), df.where("seq between 9 and 19"), df.where("seq >= 20")):
        landing.deliver(part)
        step(streams.write_latest(streams.stream_threads(landing.stream(df.schema)), landing.out, landing.state, available_now=True))
    hours = spark.read.parquet(landing.out)
    got = streams.threads_of_hours(hours)
    # The row that came twice is counted twice: repeats are dropped by stream_dedup.
    batch = thread_rollup(df.unionByName(df.where("seq = 9"))).select(*got.columns)
    assert sorted(got.collect()) == sorted(batch.collect())
    recent = streams.threads_of_hours(hours, 30 * 3_600, "3 hours").collect()
    assert sorted((r.thread_id, r.message_count) for r in recent) == [("c0", 1), ("c1", 1), ("c2", 1)]
    with pytest.raises(Exception, match="whole hour"):  # messages of an hour are no longer told apart
        streams.threads_of_hours(hours, 29 * 3_600 + 1_800, "3 hours").collect()
    # Only hours that changed were written again, and the state has let go of the others.
    assert hours.count() == 31 and hours.select("batch").distinct().count() == 3
    before = sorted(got.collect())
    assert streams.fold_batches(spark, landing.out, ["hour", "thread_id"]) == 1
    again = spark.read.parquet(landing.out)
    assert sorted(streams.threads_of_hours(again).collect()) == before and again.select("batch").distinct().count() == 2


class Stops:
    """A session whose file system refuses, or dies at, the change with this number."""

    def __init__(self, spark, at, dies):
        self.read, self._jsc, self._jvm, self.at, self.dies = spark.read, spark._jsc, self, at, dies
        self.org = self.apache = self.hadoop = self.fs = self
        self.paths, self.changes = spark._jvm.org.apache.hadoop.fs.Path, 0

    def Path(self, name):
        path = self.paths(name)
        path.getFileSystem = lambda conf: self.held(self.paths(name).getFileSystem(conf))
        return path

    def held(self, real):
        def change(do):
            def call(*args):
                self.changes += 1
                if self.changes - 1 != self.at:
                    return do(*args)
                if self.dies:
                    raise InterruptedError
                return False
            return call

        class Held:
            listStatus, rename, delete = real.listStatus, change(real.rename), change(real.delete)
        return Held


@pytest.mark.parametrize("dies", [True, False])
def test_a_fold_that_stops_half_way_loses_no_current_row(spark, rows, tmp_path, dies):
    hour = "hour timestamp, thread_id string, n bigint, _last struct<timestamp:bigint,seq:bigint,text:string>, _first struct<seq:bigint,title:string>"
    batches = [[("a", 1)], [("a", 2), ("b", 5)], [("a", 3), ("c", 7)], [("d", 1)]]
    stopped, done = 0, False
    while not done:
        path = str(tmp_path / f"out{stopped}")
        for number, batch in enumerate(batches):
            rows(hour, *[(None, k, n, (n, n, f"t{n}"), (0, k)) for k, n in batch]).coalesce(1).write.parquet(f"{path}/batch={number}")
        threads = lambda: sorted(streams.threads_of_hours(spark.read.parquet(path)).collect())
        before, session = threads(), Stops(spark, stopped, dies)
        try:
            streams.fold_batches(session, path, ["hour", "thread_id"])
        except OSError:
            pass
        done = session.changes <= stopped
        assert threads() == before
        streams.fold_batches(spark, path, ["hour", "thread_id"])
        assert threads() == before
        stopped += 1
    assert stopped > 3 and spark.read.parquet(path).select("batch").distinct().count() == 2


def test_rolling_counts_add_up_hours(spark, rows, landing):
    landing.deliver(events(rows, (1, "2024-01-10 00:10:00", "a"), (2, "2024-01-10 00:50:00", "a"), (3, "2024-01-10 01:10:00", "a"), (4, "2024-01-20 00:00:00", "z")))
    counts = streams.stream_rolling_counts(landing.stream(ROW), F.col("kind"), window="3 hours")
    step(streams.append_to_table(counts, landing.out, landing.state, available_now=True))
    got = {(r.window_end.strftime("%d %H"), r.thread_id): r.message_count
           for r in spark.read.parquet(landing.out).withColumn("window_end", F.col("window_end")).collect()}
    assert {k: v for k, v in got.items() if k[1] == "a"} == {
        ("10 01", "a"): 2, ("10 02", "a"): 3, ("10 03", "a"): 3, ("10 04", "a"): 1}


def test_rolling_threads_let_messages_leave(spark, rows, landing):
    data = [(1, "c", "Old", "10:10", "one"), (2, "c", "New", "10:50", "two"), (3, "c", "New", "11:10", "three"), (9, "z", "z", "23:00", "z")]
    df = rows("seq bigint, chat_id string, chat_name string, at string, text string", *data).selectExpr(
        "seq", "chat_id", "chat_name", "'' as sender", "text", "to_timestamp(concat('2024-01-10 ', at)) as ts",
        "unix_timestamp(to_timestamp(concat('2024-01-10 ', at))) as timestamp")
    landing.deliver(df)
    step(streams.append_to_table(streams.stream_rolling_threads(
        landing.stream(df.schema), window="2 hours"), landing.out, landing.state, available_now=True))
    got = {r.window_end.strftime("%H"): (r.title, r.message_count, r.last_message, r.first_seq)
           for r in spark.read.parquet(landing.out).where("thread_id = 'c'").collect()}
    assert got == {"11": ("Old", 2, "two", 1), "12": ("Old", 3, "three", 1), "13": ("New", 1, "three", 3)}


def test_summaries_of_a_repeated_batch_are_not_made_twice(spark, rows, landing, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    folder = str(marks)

    def load():
        import uuid
        from pathlib import Path

        def call(prompts, budgets):
            for _ in prompts:
                Path(folder, uuid.uuid4().hex).touch()
            return ["made"] * len(prompts)
        return call

    request = "seq bigint, email_id string, subject string, sender string, email_date string, body string"
    store = SummaryStore(spark, str(tmp_path / "store"))
    for seq, key in ((1, "a"), (2, "b"), (3, "a")):
        landing.deliver(rows(request, (seq, key, "s", "f", "d", "text")))
        stream = streams.refresh_stream(spark, landing.folder, request, files_per_trigger=1)
        step(streams.stream_summarize(stream, store, {"m": load}, lambda: 0, landing.state, landing.out, available_now=True))
    assert sorted((r.seq, r.cached) for r in spark.read.parquet(landing.out).collect()) == [(1, False), (2, False), (3, True)]
    # All over again with a new state folder: everything comes from the store.
    stream = streams.refresh_stream(spark, landing.folder, request)
    step(streams.stream_summarize(stream, store, {"m": load}, lambda: 0, landing.state + "2", available_now=True))
    assert len(os.listdir(marks)) == 2 and store.read().count() == 2


def test_a_checkpoint_made_anew_under_the_same_path_loses_nothing(spark, rows, landing, tmp_path):
    import shutil
    request = "seq bigint, email_id string, subject string, sender string, email_date string, body string"
    store = SummaryStore(spark, str(tmp_path / "store"))
    made = lambda: lambda prompts, budgets: ["made"] * len(prompts)
    run = lambda: step(streams.stream_summarize(
        streams.refresh_stream(spark, landing.folder, request), store, {"m": made}, lambda: 0, landing.state, available_now=True))
    landing.deliver(rows(request, (1, "a", "s", "f", "d", "text")))
    run()
    shutil.rmtree(landing.state)
    landing.deliver(rows(request, (2, "b", "s", "f", "d", "text")))
    run()
    assert sorted(r.email_id for r in store.read().collect()) == ["a", "b"]


@pytest.mark.parametrize("copies", [1, 2])
def test_a_landed_part_is_one_batch_of_many_files(spark, rows, tmp_path, monkeypatch, copies):
    from checks import streams as landings
    monkeypatch.setattr(landings, "PER_FILE", 50)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batches = []

    def look(batch, _):
        day = batch.select(F.dayofmonth("ts").alias("d"), F.input_file_name().alias("f"))
        batches.append(day.agg(F.min("d"), F.max("d"), F.count("*"), F.count_distinct("f")).first())

    stream = landings._events(spark, "/root/testdata/sf0.001", copies=copies)
    step(stream.writeStream.foreachBatch(look).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    parts = [events.where(w).count() for w in ("day(ts) <= 10", "day(ts) between 11 and 20", "day(ts) > 20")]
    assert [b[2] for b in batches] == [n for n in parts for _ in range(copies)]
    assert [b[3] for b in batches] == [-(-min(parts) // 50)] * 3 * copies and min(parts) > 100


def test_parts_without_rows_are_landed_too(spark, rows, tmp_path):
    from checks import streams as landings
    some = rows("n int", (1,), (2,))
    for parts, want in (([some.where("false"), some, some.where("n = 2")], [1, 2, 2]), ([some.where("false")] * 3, [])):
        out = landings._through(landings._landed(spark, parts, some.schema), spark)
        assert sorted(r.n for r in out.collect()) == want


def test_a_repeated_batch_gives_the_rows_of_the_first_time(spark, rows, tmp_path, monkeypatch):
    from checks.models import length_model
    from feedfold.plans.summarize import summarize_emails

    store = SummaryStore(spark, str(tmp_path / "store"))
    asked = rows("seq bigint, email_id string, subject string, sender string, email_date string, body string",
                 *[(i, f"m{i % 20}" if i % 7 else None, f"s{i}", "a", "2024-01-01", f"body {i}") for i in range(60)])
    run = lambda tag=None: sorted(map(str, summarize_emails(asked, store, {"length": length_model}, 1_706_659_200, tag=tag).collect()))
    # The driver is lost after the entry, before the store has the summaries.
    settle = SummaryStore.settle
    monkeypatch.setattr(SummaryStore, "settle", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run("b1")
    monkeypatch.setattr(SummaryStore, "settle", settle)
    monkeypatch.setattr("feedfold.plans.summarize.generate_misses", lambda *a: (_ for _ in ()).throw(RuntimeError("asked again")))
    first = run("b1")
    kept = sorted(map(str, store.read().collect()))
    assert sum("cached=False" in r for r in first) >= 20 and first == run("b1") and sorted(map(str, store.read().collect())) == kept
    monkeypatch.undo()
    again = run("b2")
    assert again != first and sum("cached=True" in r for r in again) > sum("cached=True" in r for r in first)
