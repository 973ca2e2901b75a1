"""Filters, fields, caps and message threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold import fixed
from feedfold.columns import quoted
from feedfold.functions import fields
from feedfold.operators import filters, ranking, threads
from feedfold.plans import mail, message_threads as mt
from feedfold.sources import message_tables as tables

from . import adapters as a
from .adapters import ACCOUNT, AS_OF, THREAD_KEY, THREAD_TITLE, first_truthy, sql_time, with_ctes

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


# Filters ---------------------------------------------------------------------------

@query("look_back", with_ctes("f_emails", f"select seq, id, date_text from f_emails where date_ts > {AS_OF} - 48 * 3600"))
def _(spark, sf):
    return filters.look_back(a.emails(spark, sf), AS_OF, 48).select(
        "seq", "id", fields.iso_text("date").alias("date_text"))


@query("look_ahead", with_ctes("f_calendar", f"""
    select seq, title, start_text, location from f_calendar
    where start_us > {AS_OF * 10**6} and start_us < {(AS_OF + 7 * 86400) * 10**6}"""))
def _(spark, sf):
    return filters.look_ahead(a.calendar(spark, sf), AS_OF, 7).select(
        "seq", "title", fields.iso_text("start").alias("start_text"), "location")


@query("due_window", with_ctes("f_reminders", f"""
    select seq, title, due_text from f_reminders
    where due_ts >= {AS_OF} and due_ts < {AS_OF} + 3 * 86400"""))
def _(spark, sf):
    # Asked at noon: the window still starts at midnight.
    return filters.due_window(a.reminders(spark, sf), AS_OF + 43200, 3).select(
        "seq", "title", fields.iso_text("due").alias("due_text"))


@query("recent", with_ctes("f_messages", f"""
    select seq, timestamp, sender, text from f_messages
    where timestamp between {AS_OF} - 168 * 3600 and {AS_OF}"""))
def _(spark, sf):
    return filters.recent(a.messages(spark, sf), AS_OF, 168).select("seq", "timestamp", "sender", "text")


@query("recent_raw", with_ctes("t_message", f"""
    select rowid, date from t_message where date >= {(AS_OF - 240 * 3600 - 978307200) * 10**9}"""))
def _(spark, sf):
    message = a.message_tables(spark, sf)["message"]
    cutoff = filters.raw_cutoff(AS_OF, 240, threads.nanos_unit(message))
    return filters.recent_raw(message, cutoff).select("rowid", "date")


@query("open_only", with_ctes("f_reminders", "select seq, title, list from f_reminders where not completed"))
def _(spark, sf):
    return filters.open_only(a.reminders(spark, sf)).select("seq", "title", "list")


@query("non_empty_text", with_ctes("t_message", "select rowid, text from t_message where text is not null and text <> ''"))
def _(spark, sf):
    return filters.non_empty_text(a.message_tables(spark, sf)["message"]).select("rowid", "text")


# Dates as text, some of which no calendar has.
_RAW_DATE = "'2024-' || lpad(cast(doc_id % 14 as {t}), 2, '0') || '-15 10:00:00'"


@query("drop_bad_records", f"""
    select doc_id as seq, {sql_time("epoch(d)")} as date, doc_id as size from (
      select doc_id, try_cast({_RAW_DATE.format(t='varchar')} as timestamp) as d from documents)
    where d is not null""")
def _(spark, sf):
    raw = a.table(spark, sf, "documents").selectExpr(
        "doc_id as seq", _RAW_DATE.format(t="string") + " as date", "cast(doc_id as string) as size")
    good = filters.drop_bad_records(raw, {"date": "timestamp", "size": "bigint"})
    return good.withColumn("date", fields.iso_text("date"))


@query("find_email", with_ctes("f_emails", f"""
    with pool as (
      select * from (select *, row_number() over (partition by account_id order by seq) r from f_emails
                     where date_ts > {AS_OF} - 48 * 3600) where r <= 50)
    select account_id, subject, "from", min(seq) as seq from pool
    where subject is not null and "from" is not null group by all"""))
def _(spark, sf):
    emails = a.emails(spark, sf)
    wanted = emails.select("account_id", "subject", quoted("from").alias("sender"))
    return mail.find_email(emails, wanted, AS_OF, ACCOUNT).select("account_id", "subject", "from", "seq")


_ERRORS = f"""
    select seq, 'item_summary' as form, case when coalesce(kind, '') = '' or coalesce(content, '') = '' then '{fixed.ERROR_ITEM}'
      when kind not in ('calendar', 'reminder', 'messages') then '{fixed.ERROR_KIND}' || kind end as error from f_items
    union all
    select seq, 'item_question', case when coalesce(kind, '') = '' or coalesce(content, '') = '' or coalesce(question, '') = ''
      then '{fixed.ERROR_ITEM_QUESTION}' end from f_items
    union all
    select seq, 'email_question', case when coalesce(question, '') = '' or coalesce(content, '') = ''
      then '{fixed.ERROR_EMAIL_QUESTION}' end from f_items
    union all
    select seq, 'email_summary', case when coalesce(body, '') = '' then '{fixed.ERROR_NO_BODY}' end from f_requests"""


@query("valid_request", with_ctes("f_requests f_items", _ERRORS))
def _(spark, sf):
    items = a.item_requests(spark, sf)
    mails = a.email_requests(spark, sf)
    inputs = {"item_summary": items, "item_question": items,
              "email_question": items.withColumnRenamed("content", "body"), "email_summary": mails}
    parts = [
        filters.check_requests(rows, form).select("seq", F.lit(form).alias("form"), "error")
        for form, rows in inputs.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Fields ----------------------------------------------------------------------------

@query("first_truthy", with_ctes("f_messages", f"select seq, {THREAD_KEY} as key, {THREAD_TITLE} as title from f_messages"))
def _(spark, sf):
    return a.messages(spark, sf).select("seq", fields.thread_key().alias("key"), fields.thread_title().alias("title"))


@query("event_id_fallback", with_ctes("f_calendar", """
    select seq, case when seq % 2 = 0 then id when seq % 5 = 0 then 'own-' || id
      else calendar || ':' || coalesce(title, '') || ':' || start_text end as event_id from f_calendar"""))
def _(spark, sf):
    events = a.calendar(spark, sf).withColumns({
        "uid": F.expr("case when seq % 2 = 0 then id else '' end"),
        "own": F.expr("case when seq % 5 = 0 then concat('own-', id) end"),
    })
    chosen = fields.event_id("uid", "own", "calendar", "title", fields.iso_text("start"))
    return events.select("seq", chosen.alias("event_id"))


@query("export_chat_id_fallback", with_ctes("f_messages", "select seq, coalesce(nullif(chat_id, ''), chat_name, '') as chat_id from f_messages"))
def _(spark, sf):
    return a.messages(spark, sf).select("seq", fields.export_chat_id("chat_id", "chat_name").alias("chat_id"))


@query("label_own_messages", with_ctes("f_messages", f"""
    select seq, case when sender = '' and lower(direction) = 'outgoing' then 'Me' else sender end as sender,
      {THREAD_TITLE} as title from f_messages"""))
def _(spark, sf):
    return threads.thread_messages(a.messages(spark, sf)).select("seq", "sender", "title")


@query("size_tier", with_ctes("f_emails", r"""
    select seq, n as body_length, cast(ceil(n / 4) as bigint) as estimated_tokens,
      case when ceil(n / 4) > 20000 then 'Large' when ceil(n / 4) > 10000 then 'Medium' end as size_tier
    from (select seq, nullif(length(body) + length(regexp_replace(body, '[^\x{10000}-\x{10FFFF}]', '', 'g')), 0) as n
          from f_emails)"""))
def _(spark, sf):
    return fields.with_sizes(a.emails(spark, sf)).select("seq", "body_length", "estimated_tokens", "size_tier")


@query("token_budget", with_ctes("f_emails", """
    select seq, least(2048, greatest(128, greatest(1, length(body) // 4) // 2)) as budget from f_emails"""))
def _(spark, sf):
    return a.emails(spark, sf).select("seq", fields.token_budget("body").alias("budget"))


@query("display_defaults", with_ctes("f_emails f_calendar f_reminders f_messages", f"""
    select 'mail' as feed, cast(seq as varchar) as key, {first_truthy('subject', "'No Subject'")} as title,
      {first_truthy('"from"', "'Unknown'")} as detail, date_text as date_label from f_emails
    union all select 'event', cast(seq as varchar), {first_truthy('title', "'Untitled Event'")},
      {first_truthy('calendar', "'Calendar'")}, start_text from f_calendar
    union all select 'reminder', cast(seq as varchar), {first_truthy('title', "'Untitled Reminder'")},
      {first_truthy('list', "'Reminders'")}, {first_truthy('due_text', "'Unknown date'")} from f_reminders
    union all select 'thread', {THREAD_KEY}, arg_min({THREAD_TITLE}, seq),
      arg_max(text, row(timestamp, seq)), strftime(make_timestamp(max(timestamp) * 1000000), '%Y-%m-%d %H:%M:%S')
      from f_messages group by {THREAD_KEY}"""))
def _(spark, sf):
    names = ("feed", "key", "title", "detail", "date_label")
    rolled = threads.thread_rollup(a.messages(spark, sf))
    parts = [
        fields.email_labels(a.emails(spark, sf)).select(
            F.lit("mail"), F.col("seq").cast("string"), "subject_label", "from_label", "date_label"),
        fields.event_labels(a.calendar(spark, sf)).select(
            F.lit("event"), F.col("seq").cast("string"), "title_label", "calendar_label", "date_label"),
        fields.reminder_labels(a.reminders(spark, sf)).select(
            F.lit("reminder"), F.col("seq").cast("string"), "title_label", "list_label", "date_label"),
        fields.thread_labels(rolled).select(
            F.lit("thread"), "thread_id", "title_label", "preview_label", "date_label"),
    ]
    out = parts[0].toDF(*names)
    for part in parts[1:]:
        out = out.union(part.toDF(*names))
    return out


# Epochs in the shapes found in exports: digits, padded, single digits, other text.
_EPOCH_TEXT = """case {key} % 6 when 0 then cast({epoch} as {t}) when 1 then '  ' || cast({epoch} as {t}) || ' '
  when 2 then {iso} when 3 then '2024-2-3 1:2:3' when 4 then {iso} || ' PM' else '' end"""


@query("parse_epoch", with_ctes("f_messages", """
    select seq, case chat_seq % 6 when 0 then timestamp when 1 then timestamp when 2 then timestamp
      when 3 then 1706922123 else 0 end as epoch from f_messages"""))
def _(spark, sf):
    text = _EPOCH_TEXT.format(key="chat_seq", epoch="timestamp", iso="date", t="string")
    return a.messages(spark, sf).withColumn("raw", F.expr(text)).select("seq", fields.parse_epoch("raw").alias("epoch"))


@query("to_int_or_zero", with_ctes("f_calendar", """
    select seq, case seq % 4 when 0 then start_ts when 1 then -start_ts else 0 end as n from f_calendar"""))
def _(spark, sf):
    raw = F.expr("""case seq % 4 when 0 then concat(' ', start_ts) when 1 then concat('-', start_ts)
                    when 2 then concat(start_ts, '.5') else '' end""")
    return a.calendar(spark, sf).select("seq", fields.to_int_or_zero(raw).alias("n"))


@query("epoch_from_2001", with_ctes("t_message", """
    select rowid, date // 1000000000 + 978307200 as from_nanos, date // 1000000 + 978307200 as from_seconds from t_message"""))
def _(spark, sf):
    message = a.message_tables(spark, sf)["message"]
    return message.select(
        "rowid", fields.epoch_from_2001("date", True).alias("from_nanos"),
        fields.epoch_from_2001(F.expr("date div 1000000"), False).alias("from_seconds"))


@query("iso_local", with_ctes("f_messages", "select seq, date as iso from f_messages"))
def _(spark, sf):
    return a.messages(spark, sf).select("seq", fields.iso_text(F.timestamp_seconds("timestamp")).alias("iso"))


# Relational messages ---------------------------------------------------------------

_JOINED = """
    select m.rowid as message_id, m.date, m.text, m.is_from_me, h.id as handle_id, l.chat_id as chat_rowid,
      c.chat_identifier, c.display_name
    from t_message m left join t_handle h on m.handle_id = h.rowid
      left join t_link l on m.rowid = l.message_id left join t_chat c on c.rowid = l.chat_id"""
_PROJECTED = f"""
    {first_truthy('chat_identifier', 'handle_id', 'cast(message_id as varchar)')} as chat_id,
    {first_truthy('display_name', 'handle_id', "'Unknown'")} as chat_name,
    case when is_from_me = 1 then 'Me' else {first_truthy('handle_id', "'Unknown'")} end as sender,
    case when is_from_me = 1 then 'outgoing' else 'incoming' end as direction,
    {sql_time('date // 1000000000 + 978307200')} as date,
    date // 1000000000 + 978307200 as timestamp, text"""
_MESSAGE_CTES = "t_message t_handle t_link t_chat"


@query("join_message_tables", with_ctes(_MESSAGE_CTES, f"select * from ({_JOINED})"))
def _(spark, sf):
    return threads.join_message_tables(**a.message_tables(spark, sf))


@query("message_projection", with_ctes(_MESSAGE_CTES, f"select message_id, chat_rowid, {_PROJECTED} from ({_JOINED})"))
def _(spark, sf):
    t = a.message_tables(spark, sf)
    joined = threads.join_message_tables(**t).withColumn(
        "seq", F.struct("message_id", "chat_rowid"))
    out = tables.message_projection(joined, threads.nanos_unit(t["message"]))
    return out.select("seq.*", *[c for c in out.columns if c != "seq"])


@query("detect_epoch_unit", with_ctes("t_message", """
    select account_id, max(date) > 100000000000 as nanos, cast(max(date) // 1000000000 as bigint) > 100000000000 as from_seconds
    from t_message group by account_id"""))
def _(spark, sf):
    message = a.message_tables(spark, sf)["message"]
    in_seconds = message.withColumn("date", F.expr("date div 1000000000"))
    return message.groupBy("account_id").agg(F.lit(1).alias("_one")).select(
        "account_id", threads.nanos_unit(message).alias("nanos"), threads.nanos_unit(in_seconds).alias("from_seconds"))


@query("read_message_tables", with_ctes(_MESSAGE_CTES, f"""
    select row_number() over (order by date_raw desc, message_id, chat_rowid nulls first) as seq,
      * exclude (date_raw, message_id, chat_rowid) from (
      select date as date_raw, message_id, chat_rowid, {_PROJECTED} from ({_JOINED})
      where date >= {(AS_OF - 240 * 3600 - 978307200) * 10**9} and text <> ''
      order by date_raw desc, message_id, chat_rowid nulls first limit 200)"""))
def _(spark, sf):
    return tables.read_message_tables(**a.message_tables(spark, sf), as_of=AS_OF, hours=240, count=200)


# The account of a link and of a chat is the account of the message's user; every fifth account counts seconds.
_RAW = "case when m.account_id % 5 = 0 then m.date // 1000000000 else m.date end"
_SECONDS = f"(case when account_id % 5 = 0 then date else date // 1000000000 end + 978307200)"


@query("read_message_tables_by_account", with_ctes("t_message t_handle t_link t_chat", f"""
    with c as (
      select m.account_id, m.rowid as message_id, {_RAW} as date, m.text, m.is_from_me, h.id as handle_id, l.chat_id as chat_rowid,
        c.chat_identifier, c.display_name,
        row_number() over (partition by m.account_id order by {_RAW} desc, m.rowid, l.chat_id nulls first) as seq
      from t_message m left join t_handle h on m.handle_id = h.rowid and m.account_id = h.account_id
        left join t_link l on m.rowid = l.message_id left join t_chat c on c.rowid = l.chat_id
      where m.date >= {(AS_OF - 240 * 3600 - 978307200) * 10**9} and m.text <> '')
    select account_id, seq, {first_truthy('chat_identifier', 'handle_id', 'cast(message_id as varchar)')} as chat_id,
      {first_truthy('display_name', 'handle_id', "'Unknown'")} as chat_name,
      case when is_from_me = 1 then 'Me' else {first_truthy('handle_id', "'Unknown'")} end as sender,
      case when is_from_me = 1 then 'outgoing' else 'incoming' end as direction,
      {sql_time(_SECONDS)} as date, {_SECONDS} as timestamp, text
    from c where seq <= 20"""))
def _(spark, sf):
    t = a.message_tables(spark, sf)
    owner = t["message"].select("account_id", F.col("rowid").alias("message_id"))
    links = t["chat_message_join"].join(owner, "message_id")
    chats = links.select("account_id", F.col("chat_id").alias("rowid")).distinct().join(t["chat"], "rowid")
    message = t["message"].withColumn("date", F.expr("if(account_id % 5 = 0, date div 1000000000, date)"))
    return tables.read_message_tables(message, t["handle"], links, chats, AS_OF, 240, 20, ACCOUNT)


@query("with_fallback", with_ctes("f_messages t_message t_handle", f"""
    with p as (select account_id, text from f_messages where timestamp between {AS_OF} - 48 * 3600 and {AS_OF}),
      s as (select account_id, text from t_message)
    select * from p union all select * from s where account_id not in (select account_id from p)"""))
def _(spark, sf):
    primary = filters.recent(a.messages(spark, sf), AS_OF, 48).select("account_id", "text")
    secondary = a.message_tables(spark, sf)["message"].select("account_id", "text")
    return tables.with_fallback(primary, secondary, ACCOUNT)


# Threads ---------------------------------------------------------------------------

def _rollup_sql(source: str, by: str = "") -> str:
    return f"""
    select {by} {THREAD_KEY} as thread_id, arg_min({THREAD_TITLE}, seq) as title,
      arg_max(text, row(timestamp, seq)) as last_message, arg_max(date, row(timestamp, seq)) as last_date,
      max(timestamp) as last_ts, count(*) as message_count, min(seq) as first_seq
    from {source} group by {by} {THREAD_KEY}"""


def _newest_sql(hours: int, n: int, by: str = "") -> str:
    part = f"partition by {by}" if by else ""
    return f"""(select * exclude (seq, r), r as seq from (
      select *, row_number() over ({part} order by timestamp desc, seq) as r from f_messages
      where timestamp between {AS_OF} - {hours} * 3600 and {AS_OF}) where r <= {n})"""


@query("message_threads", with_ctes("f_messages", _rollup_sql(_newest_sql(720, 200))))
def _(spark, sf):
    return mt.message_threads(a.messages(spark, sf), AS_OF, 720, 200)


@query("message_threads_by_account", with_ctes("f_messages", _rollup_sql(_newest_sql(720, 200, "account_id"), "account_id,")))
def _(spark, sf):
    return mt.message_threads(a.messages(spark, sf), AS_OF, 720, 200, ACCOUNT)


@query("thread_rollup", with_ctes("f_messages", _rollup_sql("f_messages")))
def _(spark, sf):
    return threads.thread_rollup(a.messages(spark, sf))


@query("collect_thread_messages", with_ctes("f_messages", f"""
    with c as {_newest_sql(720, 200, 'account_id')}
    select account_id, {THREAD_KEY} as thread_id, row_number() over w - 1 as pos,
      case when sender = '' and lower(direction) = 'outgoing' then 'Me' else sender end as sender, timestamp, text,
      count(*) over (partition by account_id, {THREAD_KEY}) as message_count
    from c window w as (partition by account_id, {THREAD_KEY} order by timestamp, seq)"""))
def _(spark, sf):
    nested = mt.message_threads_nested(a.messages(spark, sf), AS_OF, 720, 200, ACCOUNT)
    flat = nested.select("account_id", "thread_id", "message_count", F.posexplode("messages").alias("pos", "m"))
    return flat.select("account_id", "thread_id", F.col("pos").cast("bigint").alias("pos"),
                       "m.sender", "m.timestamp", "m.text", "message_count")


_LIST = f"list({{'s': seq, 't': text}} order by seq)"


@query("digest_threads", with_ctes("f_messages", f"""
    with c as {_newest_sql(720, 200, 'account_id')},
      g as (select account_id, {THREAD_KEY} as thread_id, {THREAD_TITLE} as title_, seq, text,
              row_number() over (partition by account_id, {THREAD_KEY} order by seq desc) as back from c)
    select account_id, thread_id, arg_min(title_, seq) as title, count(*) as message_count, min(seq) as first_seq,
      substring(coalesce(string_agg(substring(text, 1, 50), '; ' order by seq) filter (where back <= 3 and text <> ''), ''), 1, 150) as preview
    from g group by account_id, thread_id"""))
def _(spark, sf):
    newest = mt.recent_messages(a.messages(spark, sf), AS_OF, 720, 200, ACCOUNT)
    return threads.digest_threads(newest, 200, ACCOUNT)


@query("last_n_preview", with_ctes("f_messages", f"""
    with c as {_newest_sql(720, 200)},
      g as (select {THREAD_KEY} as thread_id, seq, text,
              row_number() over (partition by {THREAD_KEY} order by seq desc) as back from c)
    select thread_id, substring(coalesce(string_agg(substring(text, 1, 50), '; ' order by seq) filter (where back <= 3 and text <> ''), ''), 1, 150) as preview
    from g group by thread_id"""))
def _(spark, sf):
    newest = mt.recent_messages(a.messages(spark, sf), AS_OF, 720, 200)
    return threads.digest_threads(newest, 200).select("thread_id", "preview")


@query("transcript", with_ctes("f_messages", f"""
    select account_id, {THREAD_KEY} as thread_id, string_agg(
      {first_truthy("case when sender = '' and lower(direction) = 'outgoing' then 'Me' else sender end", "'Unknown'")}
      || ': ' || text, chr(10) order by timestamp, seq) as transcript
    from {_newest_sql(720, 200, 'account_id')} group by account_id, {THREAD_KEY}"""))
def _(spark, sf):
    nested = mt.message_threads_nested(a.messages(spark, sf), AS_OF, 720, 200, ACCOUNT)
    return threads.transcripts(nested, ACCOUNT).drop("title")


# Caps and orders -------------------------------------------------------------------

def _ranked(cte: str, columns: str, order: str, n: int, where: str = "true") -> str:
    return with_ctes(cte, f"""select * from (
      select account_id, {columns}, row_number() over (partition by account_id order by {order}) as rank
      from {cte} where {where}) where rank <= {n}""")


@query("cap_by_arrival", _ranked("f_emails", "seq, subject", "seq", 10))
def _(spark, sf):
    capped = ranking.cap_by_arrival(a.emails(spark, sf).select("account_id", "seq", "subject"), 10, ACCOUNT)
    return capped.withColumn("rank", F.col("rank").cast("bigint"))


@query("cap_5000", with_ctes("t_message", """
    select two, rowid, rank from (select account_id % 2 as two, rowid, row_number() over (partition by account_id % 2 order by date desc, rowid) as rank
      from t_message) where rank <= 5000"""))
def _(spark, sf):
    rows = a.message_tables(spark, sf)["message"].select((F.col("account_id") % 2).alias("two"), "rowid", "date")
    capped = ranking.newest_n(rows, 5000, ["two"], seq="rowid").drop("date")
    return capped.withColumn("rank", F.col("rank").cast("bigint"))


@query("sort_without_cap", with_ctes("f_calendar", """
    select account_id, seq, start_ts, row_number() over (partition by account_id order by start_ts, seq) as rank from f_calendar"""))
def _(spark, sf):
    rows = ranking.sort_then_cap(a.calendar(spark, sf).select("account_id", "seq", "start_ts"), 0, ACCOUNT)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("cap_then_sort", with_ctes("f_reminders", f"""
    select account_id, seq, due_ts, row_number() over (partition by account_id order by due_ts, seq) as rank from (
      select *, row_number() over (partition by account_id order by seq) as r from f_reminders
      where not completed and due_ts >= {AS_OF} and due_ts < {AS_OF} + 300 * 86400) where r <= 10"""))
def _(spark, sf):
    due = filters.due_window(filters.open_only(a.reminders(spark, sf)), AS_OF, 300)
    capped = ranking.cap_then_sort(due.select("account_id", "seq", "due_ts"), 10, ACCOUNT)
    return capped.withColumn("rank", F.col("rank").cast("bigint"))


@query("sort_then_cap", _ranked("f_calendar", "seq, start_ts", "start_ts, seq", 20,
                                f"start_us > {AS_OF * 10**6} and start_us < {(AS_OF + 7 * 86400) * 10**6}"))
def _(spark, sf):
    ahead = filters.look_ahead(a.calendar(spark, sf), AS_OF, 7).select("account_id", "seq", "start_ts")
    return ranking.sort_then_cap(ahead, 20, ACCOUNT).withColumn("rank", F.col("rank").cast("bigint"))


@query("cap_across_groups", with_ctes("f_messages", """
    select seq, chat_seq, timestamp, rank from (
      select *, row_number() over (order by chat_seq, timestamp desc, seq) as rank from f_messages) where rank <= 200"""))
def _(spark, sf):
    rows = a.messages(spark, sf).select("seq", "chat_seq", "timestamp")
    return ranking.cap_across_groups(rows, 200).withColumn("rank", F.col("rank").cast("bigint"))


@query("newest_n", _ranked("t_message", "rowid, date, text", "date desc, rowid", 20))
def _(spark, sf):
    message = a.message_tables(spark, sf)["message"].select("account_id", "rowid", "date", "text")
    return ranking.newest_n(message, 20, ACCOUNT, seq="rowid").withColumn("rank", F.col("rank").cast("bigint"))


@query("threads_by_recency", with_ctes("f_messages", f"""
    select thread_id, last_ts, row_number() over (order by last_ts desc, first_seq) as place
    from ({_rollup_sql(_newest_sql(48, 200))})"""))
def _(spark, sf):
    # At most 200 threads are left to be numbered.
    flat = mt.message_threads(a.messages(spark, sf), AS_OF, 48, 200)
    placed = ranking.first_n(flat, 200, [F.desc("last_ts"), "first_seq"], rank="place")
    return placed.select("thread_id", "last_ts", F.col("place").cast("bigint").alias("place"))


@query("threads_by_volume", with_ctes("f_messages", f"""
    select account_id, thread_id, message_count, rank from (
      select *, row_number() over (partition by account_id order by message_count desc, first_seq) as rank
      from ({_rollup_sql('f_messages', 'account_id,')})) where rank <= 5"""))
def _(spark, sf):
    rolled = threads.thread_rollup(a.messages(spark, sf), ACCOUNT)
    top = ranking.threads_by_volume(rolled, 5, ACCOUNT)
    return top.select("account_id", "thread_id", "message_count", F.col("rank").cast("bigint").alias("rank"))


@query("keep_first", """
    select event_type, user_id, arg_min(event_id, row(value, event_id)) as event_id from events group by event_type, user_id""")
def _(spark, sf):
    events = a.table(spark, sf, "events").select("event_type", "user_id", "value", "event_id")
    return ranking.keep_first(events, ["event_type", "user_id"], ["value", "event_id"]).drop("value")
