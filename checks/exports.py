"""Export files made from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedfold.columns import quoted
from feedfold.entities import EMAIL_EXPORT_FIELDS
from feedfold.functions.fields import iso_text
from feedfold.session import scratch_path
from feedfold.sources import exports

from feedfold.plans import daily_digest as dd

from . import adapters as a
from .adapters import AS_OF, with_ctes
from .digests import _PROMPT, _WHOLE, FEEDS, blocks_sql

QUERIES, ORACLES = {}, {}
RECORDS_PER_FILE = 2000


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def _write_arrays(df: DataFrame, seq: Column, path: str, places: int = RECORDS_PER_FILE) -> None:
    """JSON array files of a fixed number of consecutive places, in the order of their names."""
    item = F.to_json(F.struct(*[quoted(c) for c in df.columns]))
    (
        df.select(F.format_string("%012d", F.floor(seq / places)).alias("file"), seq.alias("seq"), item.alias("item"))
        .groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("items"))
        .select("file", F.concat(
            F.lit("["), F.array_join(F.transform("items", lambda i: i["item"]), ",\n"), F.lit("]")).alias("value"))
        .write.partitionBy("file").text(path)
    )


_RECORD = "'{' || concat_ws(',', " + ", ".join(
    f"'\"{name}\":\"' || {column} || '\"'"
    for name, column in zip(EMAIL_EXPORT_FIELDS, ("id", "date_text", '"from"', "subject", "body"))
) + ") || '}'"


def _found(name: str) -> str:
    """A field's text by its pattern; NULL where the pattern does not occur."""
    pattern, flags = (
        (r'"body":"(.*?)"(?:,|\})', "'s'") if name == "body" else (f'"{name}":"([^"]*)"', "''")
    )
    return f"case when regexp_matches(r, '{pattern}', {flags}) then regexp_extract(r, '{pattern}', 1, {flags}) end as \"{name}\""


@query("read_mail_export", with_ctes("f_emails", rf"""
    with r as (select unnest(regexp_extract_all({_RECORD}, '\{{[^}}]+\}}')) as r from f_emails),
      f as (select {', '.join(_found(n) for n in EMAIL_EXPORT_FIELDS)} from r)
    select * from f where coalesce(id, date, "from", subject, body) is not null"""))
def _(spark, sf):
    path = scratch_path(spark, "mail-export")
    mails = a.emails(spark, sf).withColumn("date", iso_text("date"))
    fields = [F.concat(F.lit(f'"{n}":"'), quoted(n), F.lit('"')) for n in EMAIL_EXPORT_FIELDS]
    mails.select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("},"))).write.text(path)
    return exports.read_mail_export(spark, path).select(*EMAIL_EXPORT_FIELDS)


@query("read_calendar_export", with_ctes("f_calendar", """
    select id, title, start_text as start, end_text as "end", start_ts, end_ts, location, notes, calendar from f_calendar"""))
def _(spark, sf):
    path = scratch_path(spark, "calendar-export")
    events = a.calendar(spark, sf).withColumns({
        "start": iso_text("start"), "end": iso_text(quoted("end")),
        "start_ts": F.col("start_ts").cast("string"), "end_ts": F.col("end_ts").cast("string")})
    _write_arrays(events.drop("account_id"), F.col("seq"), path)
    return exports.read_calendar_export(spark, path).drop("file", "seq")


@query("read_reminder_export", with_ctes("f_reminders", """
    select id, title, due_text as due, coalesce(due_ts, 0) as due_ts, notes, list from f_reminders"""))
def _(spark, sf):
    path = scratch_path(spark, "reminder-export")
    reminders = a.reminders(spark, sf).withColumns({"due": iso_text("due"), "due_ts": iso_text("due")})
    _write_arrays(reminders.drop("account_id", "completed"), F.col("seq"), path)
    return exports.read_reminder_export(spark, path).drop("file", "seq")


@query("read_message_export", with_ctes("f_messages", """
    select chat_id, chat_name, sender, direction, date, timestamp, text from f_messages"""))
def _(spark, sf):
    path = scratch_path(spark, "message-export")
    # The epoch is found in the date where the timestamp is empty.
    messages = a.messages(spark, sf).withColumn(
        "timestamp", F.expr("case when chat_seq % 2 = 0 then date else '' end"))
    position = F.expr("seq div 131072")  # few conversations per file
    _write_arrays(messages.drop("account_id", "chat_seq"), position, path)
    return exports.read_message_export(spark, path).drop("file", "seq")


# The one path of a user: four exports, their entities, windows, caps, blocks and the prompt.
@query("digest_from_exports", with_ctes(FEEDS, f"with {blocks_sql('')}, d as ({_WHOLE}) select {_PROMPT} as prompt from d"))
def _(spark, sf):
    path = scratch_path(spark, "exports")
    mails = a.emails(spark, sf).withColumn("date", iso_text("date"))
    fields = [F.concat(F.lit(f'"{n}":"'), quoted(n), F.lit('"')) for n in EMAIL_EXPORT_FIELDS]
    mails.orderBy("seq").select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("},"))).write.text(f"{path}/mail")
    events = a.calendar(spark, sf).withColumns({"start": iso_text("start"), "end": iso_text(quoted("end"))})
    _write_arrays(events.drop("account_id"), F.col("seq"), f"{path}/calendar")
    reminders = a.reminders(spark, sf).where("not completed").withColumns({"due": iso_text("due"), "due_ts": iso_text("due")})
    _write_arrays(reminders.drop("account_id", "completed"), F.col("seq"), f"{path}/reminders")
    _write_arrays(a.messages(spark, sf).drop("account_id", "chat_seq"), F.col("seq"), f"{path}/messages", 250 * 1048576)
    return dd.daily_digest(
        exports.exported_emails(exports.read_mail_export(spark, f"{path}/mail")),
        exports.exported_calendar(exports.read_calendar_export(spark, f"{path}/calendar")),
        exports.exported_reminders(exports.read_reminder_export(spark, f"{path}/reminders")),
        exports.read_message_export(spark, f"{path}/messages"), AS_OF).select("prompt")
