import pytest
from pyspark.sql import functions as F

from feedfold.functions import fields, lines


@pytest.mark.parametrize("given, epoch", [
    (None, 0), ("", 0), ("12", 12), (" 12 ", 12), ("2024-02-03 01:02:03", 1706922123),
    ("2024-02-30 01:02:03", 0), ("2024-2-3 1:2:3", 1706922123), ("2024-2-3", 0),
    ("2024-02-03   01:02:03", 1706922123), ("soon", 0), ("-5", 0), ("12.7", 0),
    ("2024-02-03 01:02:61", 0), ("99999999999999999999", 0),
])
def test_parse_epoch(value, given, epoch):
    assert value(fields.parse_epoch("v"), v=given) == epoch


def test_number_epoch_cuts_the_fraction(rows):
    df = rows("x double", (12.7,), (None,))
    assert [r[0] for r in df.select(fields.number_epoch("x")).collect()] == [12, 0]


@pytest.mark.parametrize("given, number", [
    (None, 0), ("", 0), ("7", 7), (" 7 ", 7), ("-7", -7), ("+7", 7), ("7.5", 0), ("x", 0),
])
def test_to_int_or_zero(value, given, number):
    assert value(fields.to_int_or_zero("v"), v=given) == number


def test_first_truthy_skips_empty_but_absent_default_keeps_it(value):
    assert value(fields.first_truthy("a", "b", F.lit("z")), a="", b="x") == "x"
    assert value(fields.first_truthy("a", "b", F.lit("z")), a="", b=None) == "z"
    assert value(fields.absent_default("a", "z"), a="") == ""
    assert value(fields.absent_default("a", "z"), a=None) == "z"


def test_event_id(value):
    def chosen(**given):
        return value(fields.event_id("uid", "own", "cal", "title", "start"), **given)
    base = dict(cal="Work", title=None, start="s")
    assert chosen(uid="u", own="o", **base) == "u"
    assert chosen(uid="", own="o", **base) == "o"
    assert chosen(uid="", own=None, **base) == "Work::s"


def test_thread_key_and_own_label(value):
    key = fields.thread_key()
    assert value(key, chat_id="", chat_name="n", sender="s") == "n"
    assert value(key, chat_id=None, chat_name="", sender="s") == "s"
    assert value(key, chat_id="", chat_name="", sender="") == "unknown"
    own = fields.own_label()
    assert value(own, sender="", direction="OUTgoing") == "Me"
    assert value(own, sender=None, direction="outgoing") == "Me"
    assert value(own, sender="", direction="incoming") == ""
    assert value(own, sender="Ann", direction="outgoing") == "Ann"
    assert value(own, sender="", direction=None) == ""
    assert value(fields.speaker(), sender="", direction="in") == "Unknown"


def test_epoch_from_2001(value):
    nanos = fields.epoch_from_2001(F.lit(1_999_999_999).cast("bigint"), True)
    assert value(nanos) == 978307200 + 1
    assert value(fields.epoch_from_2001(F.lit(5).cast("bigint"), False)) == 978307205


def test_sizes(spark, rows):
    df = rows("seq int, body string", (0, "a" * 40000), (1, "a" * 40001), (2, "a" * 80000),
              (3, "a" * 80001), (4, "\U0001F600b"), (5, ""), (6, None))
    got = {r.seq: (r.body_length, r.estimated_tokens, r.size_tier) for r in fields.with_sizes(df).collect()}
    assert got[0] == (40000, 10000, None)
    assert got[1] == (40001, 10001, "Medium")
    assert got[2] == (80000, 20000, "Medium")
    assert got[3] == (80001, 20001, "Large")
    assert got[4] == (3, 1, None)
    assert got[5] == got[6] == (None, None, None)


@pytest.mark.parametrize("length, budget", [(0, 128), (1024, 128), (1032, 129), (16384, 2048), (99999, 2048)])
def test_token_budget(value, length, budget):
    assert value(fields.token_budget("v"), v="x" * length) == budget


def test_email_line(value):
    def line(**given):
        return value(lines.email_line(), **given)
    assert line(**{"from": None, "subject": None, "body": None}) == "- From: Unknown, Subject: No Subject"
    assert line(**{"from": "", "subject": "s", "body": " \n "}) == "- From: , Subject: s"
    assert line(**{"from": "a", "subject": "s", "body": "x\ny"}) == "- From: a, Subject: s - x y..."
    assert line(**{"from": "a", "subject": "s", "body": "x" * 201}) == "- From: a, Subject: s - " + "x" * 200 + "..."


def test_item_lines_and_contents(rows):
    event = rows("title string, start timestamp, `end` timestamp, location string, notes string, calendar string",
                 (None, None, None, "", None, ""))
    assert event.select(lines.event_line()).first()[0] == "- Untitled at TBD"
    assert event.select(lines.event_content()).first()[0] == "Calendar: Calendar\nStart: Unknown\nEnd: Unknown"
    due = rows("title string, due timestamp, notes string, list string", ("", None, "n", None))
    assert due.select(lines.reminder_line()).first()[0] == "- "
    assert due.select(lines.reminder_content()).first()[0] == "List: Reminders\nDue: Today\nNotes: n"
