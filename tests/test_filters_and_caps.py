from pyspark.sql import functions as F

from feedfold.operators import filters, ranking

NOW = "2024-01-31 12:00:00"
EPOCH = 1706702400


def kept(df, column="n"):
    return sorted(r[0] for r in df.select(column).collect())


def moments(rows, column, *texts):
    df = rows(f"n int, t string", *enumerate(texts))
    return df.select("n", F.to_timestamp("t").alias(column))


def test_look_back_excludes_the_edge_and_keeps_the_future(rows):
    df = moments(rows, "date", "2024-01-30 12:00:00", "2024-01-30 12:00:01", "2025-01-01 00:00:00", None)
    assert kept(filters.look_back(df, NOW, 24)) == [1, 2]


def test_look_ahead_is_open(rows):
    df = moments(rows, "start", NOW, "2024-01-31 12:00:01", "2024-02-01 11:59:59", "2024-02-01 12:00:00")
    assert kept(filters.look_ahead(df, EPOCH, 1)) == [1, 2]


def test_due_window_starts_at_midnight(rows):
    df = moments(rows, "due", "2024-01-30 23:59:59", "2024-01-31 00:00:00", "2024-01-31 23:59:59", "2024-02-01 00:00:00", None)
    assert kept(filters.due_window(df, NOW, 1)) == [1, 2]


def test_recent_is_closed(rows):
    df = rows("n int, timestamp bigint", (0, EPOCH - 3601), (1, EPOCH - 3600), (2, EPOCH), (3, EPOCH + 1), (4, None), (5, 0))
    assert kept(filters.recent(df, NOW, 1)) == [1, 2]


def test_recent_raw_keeps_the_future(rows):
    df = rows("n int, date bigint", (0, EPOCH - 978307200 - 3601), (1, EPOCH - 978307200 - 3600), (2, 10**12), (3, None))
    assert kept(filters.recent_raw(df, filters.raw_cutoff(NOW, 1, F.lit(False)))) == [1, 2]
    nanos = df.withColumn("date", F.col("date") * 1000000000 + 1).where("n < 2")
    assert kept(filters.recent_raw(nanos, filters.raw_cutoff(NOW, 1, F.lit(True)))) == [1]


def test_text_and_open(rows):
    assert kept(filters.non_empty_text(rows("n int, text string", (0, None), (1, ""), (2, " ")))) == [2]
    assert kept(filters.open_only(rows("n int, completed boolean", (0, True), (1, False)))) == [1]


def test_bad_records_fall_alone(rows):
    df = rows("n int, a string, b string", (0, "1", "2024-01-01"), (1, "x", "2024-01-01"), (2, None, "2024-01-01"), (3, "1", "2024-13-01"))
    good = filters.drop_bad_records(df, {"a": "bigint", "b": "date"})
    assert kept(good) == [0, 2]
    assert good.schema["a"].dataType.simpleString() == "bigint"


def test_request_errors(rows):
    df = rows("kind string, content string, question string, body string",
              ("calendar", "c", "q", "b"), ("other", "c", "q", ""), ("", "c", None, "b"), (None, None, "", None))
    def errors(form):
        return [r[0] for r in filters.check_requests(df, form).select("error").collect()]
    need = "kind and content are required"
    assert errors("item_summary") == [None, "Unknown kind: other", need, need]
    need = "kind, context, and question are required"
    assert errors("item_question") == [None, None, need, need]
    need = "Question and email body are required"
    assert errors("email_question") == [None, need, need, need]
    need = "No email body provided"
    assert errors("email_summary") == [None, need, None, need]


REMINDERS = [(1, 30), (2, 20), (3, 10)]


def test_cap_then_sort_is_not_the_earliest(rows):
    df = rows("seq int, due_ts int", *REMINDERS)
    got = [(r.seq, r["rank"]) for r in ranking.cap_then_sort(df, 2).orderBy("rank").collect()]
    assert got == [(2, 1), (1, 2)]


def test_sort_then_cap(rows):
    df = rows("seq int, start_ts int", *REMINDERS, (4, 10))
    assert [r.seq for r in ranking.sort_then_cap(df, 2).orderBy("rank").collect()] == [3, 4]
    assert [r.seq for r in ranking.sort_then_cap(df, 0).orderBy("rank").collect()] == [3, 4, 2, 1]


def test_cap_across_groups_starves_later_chats(rows):
    df = rows("seq int, chat_seq int, timestamp int", (1, 1, 5), (2, 1, 9), (3, 1, 7), (4, 2, 99))
    got = ranking.cap_across_groups(df, 3).orderBy("rank").collect()
    assert [r.seq for r in got] == [2, 3, 1]


def test_caps_by_account_equal_the_runs_of_each(spark, rows):
    df = spark.range(200).selectExpr("id as seq", "id % 3 as account", "(id * 37) % 50 as ts")
    whole = ranking.newest_n(df, 7, ["account"], ts="ts").select("account", "seq", "rank").collect()
    single = []
    for account in range(3):
        part = ranking.newest_n(df.where(F.col("account") == account), 7, ts="ts")
        single += part.select("account", "seq", "rank").collect()
    assert sorted(whole) == sorted(single)


def test_group_limit_is_planned_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id as seq", "id % 3 as account")
    plan = ranking.cap_by_arrival(df, 5, ["account"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # before and after each of two levels
    top = ranking.cap_by_arrival(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


def test_char_budget_stops_at_the_first_overflow(rows):
    df = rows("rank int, line string", (1, "aaa"), (2, "bbbbb"), (3, "c"))
    assert kept(ranking.char_budget(df, 5, 10), "rank") == [1]
    assert kept(ranking.char_budget(df, 2, 10), "rank") == []
    assert kept(ranking.char_budget(df, 8, 10), "rank") == [1, 2]
    assert kept(ranking.char_budget(df, 100, 2), "rank") == [1, 2]


def test_keep_first(rows):
    df = rows("k string, p int, n int", ("a", 1, 0), ("a", 0, 1), ("b", 5, 2))
    assert kept(ranking.keep_first(df, ["k"], ["p", "n"])) == [1, 2]


def test_latest_summaries_breaks_ties_by_id(rows):
    from feedfold.entities import SUMMARY
    import datetime as dt
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    df = rows(SUMMARY, *[(i, str(i), None, None, None, "b", "s", "m", t) for i in range(150)])
    top = ranking.latest_summaries(df, 100).orderBy("rank").collect()
    assert [r.id for r in top] == list(range(149, 49, -1))
    assert "body" not in top[0].asDict()


def test_caps_without_accounts_merge_in_two_levels(spark):
    """The last merge gets the first rows of shares, not of all tasks; the rows are those of a plain sort."""
    import io
    from contextlib import redirect_stdout

    from feedfold.operators import ranking

    df = spark.range(0, 20_000, 1, 40).selectExpr("id as seq", "(id * 7919) % 20000 as due_ts")
    capped = ranking.sort_then_cap(df, 3_000, sort="due_ts")
    rows = capped.orderBy("rank").collect()
    assert [r.due_ts for r in rows] == list(range(3_000)) and [r.rank for r in rows] == list(range(1, 3_001))
    with redirect_stdout(io.StringIO()) as plan:
        capped.explain("formatted")
    assert "hashpartitioning(_share" in plan.getvalue()


def test_arrival_numbers_are_dense(spark, rows):
    """Values at the ends of the range, at the edges of spans, dense runs and a row without a value."""
    edges = [-2**63, -2**48 - 1, -2**48, -2**32, -65537, -65536, -1, 0, 1, 65535, 65536, 2**32 - 1, 2**32, 2**48 - 1, 2**48, 2**62, 2**63 - 1]
    values = sorted({*edges, *range(200_000, 200_400), *range(2**40 - 50, 2**40 + 50), *range(-70_000, -60_000, 97)})
    df = rows("seq bigint, _n string", *[(v, "x") for v in reversed(values)], (None, "none"))
    got = ranking.arrival_numbers(df)
    assert got.columns == ["seq", "_n", "number"]
    assert sorted((r.seq, r.number) for r in got.where("seq is not null").collect()) == list(zip(values, range(1, len(values) + 1)))
    assert [r.number for r in got.where("seq is null").collect()] == [None]
    assert ranking.arrival_numbers(df.where("false")).count() == 0
    replaced = ranking.arrival_numbers(rows("id bigint, seq bigint", (50, 9), (60, 4)), "seq", "id")
    assert replaced.columns == ["seq", "id"] and sorted(map(tuple, replaced.collect())) == [(4, 1), (9, 2)]
