import pytest
from pyspark.sql import functions as F

from feedfold.operators import chat

TURN = "conv_id string, turn bigint, role string, content string"


def test_last_four_turns_with_the_question(rows):
    df = rows(TURN, *[("c", i, "User" if i % 2 == 0 else "bot", f"m{i}") for i in range(6)], ("d", 0, "USER", "x"))
    got = {(r.conv_id, r.turn): r.conversation for r in chat.chat_context(df).collect()}
    assert got["d", 0] == "USER: x"
    assert got["c", 1] == "User: m0\nbot: m1"
    assert got["c", 3] == "User: m0\nbot: m1\nUser: m2\nbot: m3"
    assert got["c", 5] == "User: m2\nbot: m3\nUser: m4\nbot: m5"


def test_generic_context(rows, value):
    df = rows(TURN, ("c", 0, "uSeR", "q"), ("c", 1, "assistant", "a")).withColumn("context", F.lit("base"))
    got = {r.turn: r.full_context for r in chat.chat_context_generic(df).collect()}
    assert got[1] == "base\n\nPrevious conversation:\nQ: q\nA: a"
    assert value(chat.with_previous("b", "h"), b="base", h="") == "base"
    assert value(chat.with_previous("b", "h"), b="base", h=None) == "base"


@pytest.mark.parametrize("turn", ["id", "id * 7", "id * id"])
def test_long_conversations_are_split_without_a_trace(spark, turn):
    """Spans of any size give what one window over the conversation gives, also with gaps."""
    df = spark.range(400).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('c', id % 40) end as conv_id", f"{turn} as turn",
        "'r' as role", "cast(id as string) as content")
    whole = sorted((r.conv_id, r.turn, r.conversation) for r in chat.chat_context(df).collect())
    for span in (1, 2, 3, 5, 50, 1000):
        parts = chat.trailing_lines(df, F.concat("role", F.lit(": "), "content"), 4, span=span)
        got = sorted((r.conv_id, r.turn, "\n".join(r._lines)) for r in parts.collect())
        assert got == whole, span


def test_null_keys_positions_and_turns(spark, rows):
    """One plan for all sizes: NULLs are where a plain window has them, and no job runs while planning."""
    data = [(None if i % 5 == 0 else f"c{i % 3}", None if i in (4, 9) else i * 3, None if i % 7 == 0 else "r", str(i)) for i in range(60)]
    df = rows(TURN, *data).withColumn("account", F.expr("if(content % 4 = 0, null, content % 2)"))
    line = F.coalesce(F.concat("role", F.lit(": "), "content"), F.lit("-"))
    one = chat._trailing(df.withColumn("_line", line), [F.col("account"), F.col("conv_id")], "turn", 4)
    whole = sorted(str((r.account, r.conv_id, r.turn, r._lines)) for r in one.collect())
    tracker = spark.sparkContext.statusTracker()
    for span in (1, 4, 10, 1000):
        spark.sparkContext.setJobGroup(f"plan{span}", "")
        got = chat.trailing_lines(df, line, 4, by=["account"], span=span)
        assert not tracker.getJobIdsForGroup(f"plan{span}")
        assert got.columns == [*df.columns, "_lines"]
        assert sorted(str((r.account, r.conv_id, r.turn, r._lines)) for r in got.collect()) == whole, span


def test_long_conversations_take_the_same_plan(spark):
    turns = spark.range(50).selectExpr("id % 9 as conv_id", "id as turn", "'r' as role", "'x' as content")
    longer = turns.withColumn("turn", F.col("turn") * 100_000)
    shapes = {"".join(c for c in chat.chat_context(t)._jdf.queryExecution().optimizedPlan().toString() if c.isalpha()) for t in (turns, longer)}
    assert chat.chat_context(longer).count() == 50 and shapes
