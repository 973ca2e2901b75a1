from pyspark.sql import functions as F

from feedfold import fixed
from feedfold.entities import CALENDAR_EVENT, EMAIL, MESSAGE, REMINDER
from feedfold.operators import digest
from feedfold.plans.daily_digest import count_row, daily_digest, digest_blocks

NOW = "2024-01-31 12:00:00"


def emails(rows, *data):
    """(seq, from, subject, body) received an hour ago."""
    df = rows("seq bigint, `from` string, subject string, body string", *data)
    return df.withColumn("date", F.to_timestamp(F.lit("2024-01-31 11:00:00")))


def empty(rows):
    return rows(EMAIL), rows(CALENDAR_EVENT), rows(REMINDER), rows(MESSAGE)


def test_empty_feeds_give_default_texts(rows):
    row = daily_digest(*empty(rows), NOW).first()
    assert (row.emails, row.events, row.reminders, row.messages) == (
        fixed.NO_EMAILS, fixed.NO_EVENTS, fixed.NO_REMINDERS, fixed.NO_MESSAGES)
    assert (row.n_emails, row.n_events, row.n_reminders, row.n_threads) == (0, 0, 0, 0)
    assert "## EMAILS (0 total)\nNo new emails in the last 24 hours.\n\n## CALENDAR (0 events)" in row.prompt
    assert row.prompt.endswith("briefly note it's clear.\n")
    assert count_row(digest_blocks(*empty(rows), NOW)).first() == (0, 0, 0, 0)


def test_first_line_over_budget_gives_an_empty_block(rows):
    block = digest.email_block(emails(rows, (1, "f" * 2000, "s", "b"))).first()
    assert (block.block, block.fetched) == ("", 1)


def test_counts_are_of_fetched_rows_not_of_shown_ones(rows):
    mails = emails(rows, *[(i, "a", f"s{i:02}", "") for i in range(30)])
    block = digest.email_block(mails).first()
    assert block.fetched == 15
    assert block.block.split("\n") == [f"- From: a, Subject: s{i:02}" for i in range(10)]


def test_budget_ends_at_the_first_line_that_does_not_fit(rows):
    mails = emails(rows, (1, "a" * 900, "s", ""), (2, "b" * 1200, "s", ""), (3, "c", "s", ""))
    assert digest.email_block(mails).first().block == "- From: " + "a" * 900 + ", Subject: s"


def test_reminders_are_capped_before_they_are_sorted(rows):
    df = rows("seq bigint, title string, h int", *[(i, f"r{i:02}", 23 - i) for i in range(12)])
    df = df.withColumn("due", F.expr("timestamp'2024-01-31 00:00:00' + make_interval(0, 0, 0, 0, h)"))
    block = digest.reminder_block(df.withColumn("due_ts", F.unix_timestamp("due"))).first()
    shown = [line[2:5] for line in block.block.split("\n")]
    assert shown == [f"r{i:02}" for i in range(9, 1, -1)]
    assert block.fetched == 10


def test_accounts_missing_in_one_feed_get_its_default(rows):
    mails = emails(rows, (1, "a", "s", "")).withColumn("acc", F.lit(1))
    _, calendar, reminders, messages = (df.withColumn("acc", F.lit(2)) for df in empty(rows))
    said = rows(MESSAGE, (1, "c", "Chat", "s", "in", "", 1706702400 - 60, "hi")).withColumn("acc", F.lit(2))
    got = {r.acc: r for r in daily_digest(mails, calendar, reminders, said, NOW, ["acc"]).collect()}
    assert got[1].emails == "- From: a, Subject: s" and got[1].messages == fixed.NO_MESSAGES
    assert got[2].emails == fixed.NO_EMAILS and got[2].messages == "- Chat (1 messages): hi..."
    assert (got[2].n_threads, got[2].n_emails) == (1, 0)
    assert messages.count() == 0


def test_one_account_of_many_equals_its_own_run(rows):
    mails = emails(rows, *[(i, f"f{i}", "s", "b" * i) for i in range(40)]).withColumn("acc", F.col("seq") % 3)
    rest = [df.withColumn("acc", F.lit(0).cast("bigint")) for df in empty(rows)[1:]]
    many = {r.acc: r.prompt for r in daily_digest(mails, *rest, NOW, ["acc"]).collect()}
    for acc in range(3):
        assert many[acc] == daily_digest(mails.where(F.col("acc") == acc), *empty(rows)[1:], NOW).first().prompt
