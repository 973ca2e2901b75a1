from pyspark.sql import functions as F

from feedfold.operators import threads
from feedfold.plans import message_threads as mt
from feedfold.sources import message_tables as mtab

MESSAGE = ("seq bigint, chat_id string, chat_name string, sender string, direction string, "
           "date string, timestamp bigint, text string")
SAMPLE = [
    (1, "c", "", "", "outgoing", "d1", 50, "one"),
    (2, "c", "Team", "Ann", "incoming", "d2", 70, "two"),
    (3, "c", "Team", "Bob", "incoming", "d3", 70, "three"),
    (4, "c", "Team", "Bob", "incoming", "d4", 10, None),
    (5, "", "Solo", "x", "incoming", "d5", 20, "five"),
    (6, "", "", "", None, "d6", 30, ""),
    (7, None, None, "Eve", "", "d7", 30, "seven"),
]


def test_rollup_title_is_of_the_first_message_before_own_label(rows):
    got = {r.thread_id: r for r in threads.thread_rollup(rows(MESSAGE, *SAMPLE)).collect()}
    assert set(got) == {"c", "Solo", "unknown", "Eve"}
    assert got["c"].title == "Unknown"  # first message has neither name nor sender
    # Equal times: the one extracted later is last.
    assert (got["c"].last_message, got["c"].last_date, got["c"].last_ts, got["c"].message_count) == ("three", "d3", 70, 4)
    assert got["unknown"].last_message == ""


def test_rollup_does_not_depend_on_row_order(spark, rows):
    df = rows(MESSAGE, *SAMPLE)
    one = threads.thread_rollup(df).collect()
    two = threads.thread_rollup(df.orderBy(F.desc("seq")).repartition(5)).collect()
    assert sorted(one) == sorted(two)


def test_nested_lists_agree_with_the_rollup(rows):
    df = rows(MESSAGE, *SAMPLE)
    flat = threads.thread_rollup(df).select("thread_id", "title", "last_message", "last_ts", "message_count", "first_seq")
    nested = threads.collect_thread_messages(df, 200)
    assert sorted(flat.collect()) == sorted(nested.select(*flat.columns).collect())
    c = nested.where("thread_id = 'c'").first()
    assert [m.seq for m in c.messages] == [4, 1, 2, 3]
    assert c.messages[1].sender == "Me"
    said = threads.transcripts(nested.where("thread_id = 'c'")).first().transcript
    assert said == "Bob: \nMe: one\nAnn: two\nBob: three"


def test_nested_cap_takes_the_first_extracted(rows):
    nested = threads.collect_thread_messages(rows(MESSAGE, *SAMPLE), 2)
    assert nested.select("thread_id", "message_count").collect() == [("c", 2)]


def test_empty_transcript(rows):
    df = rows("thread_id string, title string, messages array<struct<sender:string,direction:string,text:string>>", ("t", "x", []))
    assert threads.transcripts(df).first().transcript == "No messages found."


def test_preview_shows_the_oldest_and_drops_empties_after_cutting(rows):
    # Extraction order is newest first: seq 4 is the oldest.
    data = [(i, "c", "n", "s", "in", "d", 100 - i, t) for i, t in enumerate(["new", "", "b" * 60, "a"], start=1)]
    df = rows(MESSAGE, *data)
    assert threads.digest_threads(df).first().preview == "b" * 50 + "; a"
    assert threads.digest_threads(df, newest_preview=True).first().preview == "b" * 50 + "; new"
    long = rows(MESSAGE, *[(i, "c", "n", "s", "in", "d", 1, "x" * 50) for i in range(3)])
    assert threads.digest_threads(long).first().preview == ("; ".join(["x" * 50] * 3))[:150]


def test_threads_by_account_equal_the_runs_of_each(rows):
    data = [(i, str(i % 4), "", f"s{i % 3}", "in", "d", 1000 + (i * 31) % 17, f"t{i}", i % 2) for i in range(60)]
    df = rows(MESSAGE + ", account bigint", *data)
    whole = mt.message_threads(df, 2000, 1, 20, ["account"])
    single = []
    for account in range(2):
        part = mt.message_threads(df.where(F.col("account") == account), 2000, 1, 20)
        single += part.withColumn("account", F.lit(account).cast("bigint")).select(*whole.columns).collect()
    assert sorted(whole.collect()) == sorted(single)


def test_threads_come_latest_first(rows):
    data = [(1, "a", "", "", "", "", 5, "x"), (2, "b", "", "", "", "", 9, "x"), (3, "c", "", "", "", "", 9, "x")]
    got = mt.message_threads(rows(MESSAGE, *data), 10, 1).collect()
    assert [r.thread_id for r in got] == ["b", "c", "a"]


def test_a_thread_with_a_third_of_all_rows(spark):
    df = spark.range(30000).selectExpr(
        "id as seq", "case when id % 3 = 0 then 'hot' else cast(id as string) end as chat_id", "'' as chat_name",
        "'' as sender", "'in' as direction", "'d' as date", "(id * 7919) % 30000 as timestamp", "concat('t', id) as text")
    hot = threads.thread_rollup(df).where("thread_id = 'hot'").first()
    assert (hot.message_count, hot.first_seq, hot.last_ts) == (10000, 0, 29997)


# Relational source

NOW = 1_000_000_000
OFFSET = 978307200


def tables(rows, nanos=False):
    unit = 10**9 if nanos else 1
    at = lambda s: None if s is None else (NOW - OFFSET + s) * unit
    message = rows("rowid bigint, date bigint, text string, is_from_me int, handle_id bigint",
                   (1, at(-10), "two chats", 0, 1), (2, at(-20), "no chat", 1, None), (3, at(-30), "", 0, 1),
                   (4, at(-40), None, 0, 1), (5, at(99), "future", None, 9), (6, None, "no date", 0, 1), (7, at(-7200), "old", 0, 1))
    handle = rows("rowid bigint, id string", (1, "ann"), (2, "bob"))
    link = rows("message_id bigint, chat_id bigint", (1, 10), (1, 11), (5, 11))
    chat = rows("rowid bigint, chat_identifier string, display_name string", (10, "room", "Room"), (11, "quiet", ""))
    return message, handle, link, chat


def test_relational_messages(rows):
    for nanos in (False, True):
        got = mtab.read_message_tables(*tables(rows, nanos), as_of=NOW, hours=1, count=10).orderBy("seq").collect()
        assert [(r.chat_id, r.chat_name, r.sender, r.direction, r.timestamp, r.text) for r in got] == [
            ("quiet", "Unknown", "Unknown", "incoming", NOW + 99, "future"),
            ("room", "Room", "ann", "incoming", NOW - 10, "two chats"),
            ("quiet", "ann", "ann", "incoming", NOW - 10, "two chats"),
            ("2", "Unknown", "Me", "outgoing", NOW - 20, "no chat"),
        ]
        assert got[1].date == "2001-09-09 01:46:30"


def test_relational_cap_counts_joined_rows(rows):
    got = mtab.read_message_tables(*tables(rows), as_of=NOW, hours=1, count=2).orderBy("seq").collect()
    assert [r.text for r in got] == ["future", "two chats"]
    joined = threads.join_message_tables(*tables(rows))
    assert joined.where("message_id = 1").count() == 2


def test_relational_by_account_has_a_unit_each(rows):
    plain, fine = tables(rows), tables(rows, nanos=True)
    both = [a.withColumn("acc", F.lit(1)).unionByName(b.withColumn("acc", F.lit(2))) for a, b in zip(plain, fine)]
    got = mtab.read_message_tables(*both, as_of=NOW, hours=1, count=3, by=["acc"]).orderBy("acc", "seq").collect()
    assert [(r.acc, r.text, r.timestamp - NOW) for r in got] == [
        (a, t, s) for a in (1, 2) for t, s in (("future", 99), ("two chats", -10), ("two chats", -10))]


def test_fallback(rows):
    primary, secondary = rows("a int, t string", (1, "p")), rows("a int, t string", (1, "s"), (2, "s"))
    some = lambda df: sorted(tuple(r) for r in df.collect())
    assert some(mtab.with_fallback(primary, secondary)) == [(1, "p")]
    assert some(mtab.with_fallback(primary.where("a > 5"), secondary)) == [(1, "s"), (2, "s")]
    assert some(mtab.with_fallback(primary, secondary, ["a"])) == [(1, "p"), (2, "s")]
    assert some(mtab.with_fallback(primary.where("a > 5"), secondary, enabled=False)) == []
    assert some(mtab.with_fallback(primary.where("a > 5"), secondary, enabled=False, failed=True)) == [(1, "s"), (2, "s")]
    assert [mtab.fallback_enabled(s) for s in (None, "1", "TRUE", "Yes", "0", "")] == [True, True, True, True, False, False]
