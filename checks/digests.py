"""Digest blocks, counts, prompts and whole digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold import fixed
from feedfold.functions import lines
from feedfold.operators import digest, filters, ranking, threads
from feedfold.plans import daily_digest as dd, message_threads as mt
from feedfold.functions.text import markdown_to_html
from feedfold.sources import frames, reports

from . import adapters as a
from .adapters import ACCOUNT, AS_OF, with_ctes
from .feeds import THREAD_KEY, THREAD_TITLE, _newest_sql
from .models import length_model
from .texts import EMAIL_LINE, EVENT_LINE, NL, REMINDER_LINE, filled, lit

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


FEEDS = "f_emails f_calendar f_reminders f_messages"


def blocks_sql(by: str = "account_id") -> str:
    """Digest blocks in SQL, per account or (``by`` empty) over everything."""
    part = f"partition by {by}" if by else ""
    key = f"{by}," if by else ""
    group = f"group by {by}" if by else ""
    same = f"partition by {by}, k" if by else "partition by k"
    return f"""
    e0 as (select {key} {EMAIL_LINE} as line, row_number() over ({part} order by seq) as rank from f_emails
           where date_ts > {AS_OF} - 86400),
    e1 as (select *, sum(case when rank <= 10 then length(line) else 0 end) over ({part} order by rank) as used from e0 where rank <= 15),
    emails_ as (select {key} count(*) as n, coalesce(string_agg(line, {NL} order by rank) filter (where rank <= 10 and used <= 2000), '') as block from e1 {group}),
    c1 as (select {key} {EVENT_LINE} as line, row_number() over ({part} order by start_ts, seq) as rank from f_calendar
           where start_us > {AS_OF * 10**6} and start_us < {(AS_OF + 86400) * 10**6}),
    events_ as (select {key} count(*) as n, string_agg(line, {NL} order by rank) filter (where rank <= 8) as block from c1 where rank <= 10 {group}),
    r0 as (select {key} {REMINDER_LINE} as line, due_ts, seq, row_number() over ({part} order by seq) as r from f_reminders
           where not completed and due_ts >= {AS_OF} and due_ts < {AS_OF} + 86400),
    r1 as (select *, row_number() over ({part} order by due_ts, seq) as rank from r0 where r <= 10),
    reminders_ as (select {key} count(*) as n, string_agg(line, {NL} order by rank) filter (where rank <= 8) as block from r1 {group}),
    m0 as (select {key} {THREAD_KEY} as k, {THREAD_TITLE} as title_, seq, text from {_newest_sql(24, 200, by)}),
    m1 as (select *, row_number() over ({same} order by seq desc) as back from m0),
    m2 as (select {key} k, arg_min(title_, seq) as title, count(*) as size, min(seq) as first_seq,
             substring(coalesce(string_agg(substring(text, 1, 50), '; ' order by seq) filter (where back <= 3 and text <> ''), ''), 1, 150) as preview
           from m1 group by {key} k),
    m3 as (select *, '- ' || title || ' (' || size || ' messages): ' || preview || '...' as line,
             row_number() over ({part} order by size desc, first_seq) as rank from m2),
    m4 as (select *, sum(length(line)) over ({part} order by rank) as used from m3 where rank <= 5),
    messages_ as (select {key} count(*) as n, coalesce(string_agg(line, {NL} order by rank) filter (where used <= 1500), '') as block from m4 {group})"""


_KEYS = """keys as (select account_id from emails_ union select account_id from events_
      union select account_id from reminders_ union select account_id from messages_)"""
_DIGEST_COLUMNS = f"""
    coalesce(e.block, {lit(fixed.NO_EMAILS)}) as emails, coalesce(c.block, {lit(fixed.NO_EVENTS)}) as events,
    coalesce(r.block, {lit(fixed.NO_REMINDERS)}) as reminders, coalesce(m.block, {lit(fixed.NO_MESSAGES)}) as messages,
    coalesce(e.n, 0) as n_emails, coalesce(c.n, 0) as n_events, coalesce(r.n, 0) as n_reminders, coalesce(m.n, 0) as n_threads"""
_BY_ACCOUNT = f"""select account_id, {_DIGEST_COLUMNS} from keys left join emails_ e using (account_id)
    left join events_ c using (account_id) left join reminders_ r using (account_id) left join messages_ m using (account_id)"""
_WHOLE = f"""select {_DIGEST_COLUMNS.replace('e.block', "case when e.n > 0 then e.block end").replace('m.block', "case when m.n > 0 then m.block end")}
    from emails_ e, events_ c, reminders_ r, messages_ m"""
_PROMPT = lit(fixed.DIGEST_SYSTEM + "\n\n") + " || " + filled(
    fixed.DIGEST_PROMPT + "\n", **{n: n for n in (
        "emails", "events", "reminders", "messages", "n_emails", "n_events", "n_reminders", "n_threads")})


def _sources(spark, sf):
    return a.emails(spark, sf), a.calendar(spark, sf), a.reminders(spark, sf), a.messages(spark, sf)


@query("char_budget", with_ctes("f_emails", f"""
    with l as (select account_id, {EMAIL_LINE} as line, row_number() over (partition by account_id order by seq) as rank from f_emails)
    select * from (select account_id, rank, line, sum(length(line)) over (partition by account_id order by rank) :: bigint as running_chars
      from l where rank <= 10) where running_chars <= 700"""))
def _(spark, sf):
    top = digest.ranked_lines(a.emails(spark, sf), lines.email_line(), ["seq"], 10, ACCOUNT)
    kept = ranking.char_budget(top, 700, 10, ACCOUNT)
    return kept.withColumn("rank", F.col("rank").cast("bigint"))


@query("block_text", with_ctes(FEEDS, f"""
    with {blocks_sql()}
    select 'emails' as source, account_id, block, n as fetched from emails_ union all
    select 'events', account_id, block, n from events_ union all
    select 'reminders', account_id, block, n from reminders_ union all
    select 'messages', account_id, block, n from messages_"""))
def _(spark, sf):
    out = None
    for name, block in dd.digest_blocks(*_sources(spark, sf), AS_OF, ACCOUNT).items():
        part = block.select(F.lit(name).alias("source"), "account_id", "block", "fetched")
        out = part if out is None else out.unionByName(part)
    return out


@query("thread_line", with_ctes("f_messages", f"""
    with m0 as (select account_id, {THREAD_KEY} as k, {THREAD_TITLE} as title_, seq, text from {_newest_sql(720, 200, 'account_id')}),
      m1 as (select *, row_number() over (partition by account_id, k order by seq desc) as back from m0)
    select account_id, k as thread_id, '- ' || arg_min(title_, seq) || ' (' || count(*) || ' messages): ' ||
      substring(coalesce(string_agg(substring(text, 1, 50), '; ' order by seq) filter (where back <= 3 and text <> ''), ''), 1, 150) || '...' as line
    from m1 group by account_id, k"""))
def _(spark, sf):
    newest = mt.recent_messages(a.messages(spark, sf), AS_OF, 720, 200, ACCOUNT)
    return threads.digest_threads(newest, 200, ACCOUNT).select(
        "account_id", "thread_id", lines.thread_line().alias("line"))


@query("source_counts", with_ctes(FEEDS, f"""
    with a as (select account_id, 'e' as s from f_emails where date_ts > {AS_OF} - 86400 union all
      select account_id, 'c' from f_calendar where start_us > {AS_OF * 10**6} and start_us < {(AS_OF + 86400) * 10**6} union all
      select account_id, 'r' from f_reminders where not completed and due_ts >= {AS_OF} and due_ts < {AS_OF} + 86400 union all
      select account_id, 'm' from f_messages where timestamp between {AS_OF} - 86400 and {AS_OF})
    select account_id, count(*) filter (where s = 'e') as n_emails, count(*) filter (where s = 'c') as n_events,
      count(*) filter (where s = 'r') as n_reminders, count(*) filter (where s = 'm') as n_messages from a group by account_id"""))
def _(spark, sf):
    emails, calendar, reminders, messages = _sources(spark, sf)
    return digest.source_counts({
        "emails": filters.look_back(emails, AS_OF, 24),
        "events": filters.look_ahead(calendar, AS_OF, 1),
        "reminders": filters.due_window(filters.open_only(reminders), AS_OF, 1),
        "messages": filters.recent(messages, AS_OF, 24),
    }, ACCOUNT)


@query("digest_join", with_ctes(FEEDS, f"with {blocks_sql()}, {_KEYS} {_BY_ACCOUNT}"))
def _(spark, sf):
    return digest.digest_join(dd.digest_blocks(*_sources(spark, sf), AS_OF, ACCOUNT), ACCOUNT)


@query("digest_prompt", with_ctes(FEEDS, f"with {blocks_sql('')}, d as ({_WHOLE}) select {_PROMPT} as prompt from d"))
def _(spark, sf):
    return dd.daily_digest(*_sources(spark, sf), AS_OF).select("prompt")


@query("daily_digest", with_ctes(FEEDS, f"""
    with {blocks_sql()}, {_KEYS}, d as ({_BY_ACCOUNT}), p as (select account_id, {_PROMPT} as prompt from d)
    select account_id, prompt, 'Summary of ' || length(prompt) || ' characters.' as answer, 'length' as model_used from p"""))
def _(spark, sf):
    digests = dd.daily_digest(*_sources(spark, sf), AS_OF, ACCOUNT)
    return dd.write_digests(digests, {"length": length_model}).select(
        "account_id", "prompt", "answer", "model_used")


@query("digest_frames", with_ctes(FEEDS, f"""
    with {blocks_sql()}, {_KEYS}, d as ({_BY_ACCOUNT}), p as (select account_id, length({_PROMPT}) as n from d)
    select account_id, cast(i as integer) as frame_no, case i
      when 0 then to_json({{'type': 'status', 'phase': 'gathering', 'message': 'Gathering your data...'}}) :: varchar
      when 1 then to_json({{'type': 'status', 'phase': 'analyzing', 'message': 'Analyzing content...'}}) :: varchar
      when 2 then to_json({{'type': 'status', 'phase': 'generating', 'message': 'Generating your digest...'}}) :: varchar
      when 3 then to_json({{'type': 'chunk', 'content': 'Summary of ' || n || ' characters.'}}) :: varchar
      when 4 then to_json({{'type': 'model', 'content': 'length'}}) :: varchar
      else to_json({{'type': 'done'}}) :: varchar end as frame
    from (select *, unnest(range(0, 6)) as i from p)"""))
def _(spark, sf):
    digests = dd.daily_digest(*_sources(spark, sf), AS_OF, ACCOUNT)
    return frames.digest_frames(dd.write_digests(digests, {"length": length_model}), ACCOUNT)


@query("digest_page", with_ctes(FEEDS, f"""
    with {blocks_sql()}, {_KEYS}, d as ({_BY_ACCOUNT})
    select account_id, '=== DAILY DIGEST ===' || {NL} || 'Generated: 2024-01-31 00:00:00' || {NL} || 'Model: Default' || {NL} || {NL}
      || repeat('=', 50) || {NL} || {NL} || emails || {NL} || {NL} || events || {NL} || {NL} || reminders || {NL} || {NL} || messages
      || {NL} || {NL} || repeat('=', 50) || {NL} || '=== END OF DIGEST ===' || {NL} as report,
      case when n_reminders > 0 then '<p><ul>' || regexp_replace(replace(replace(replace(reminders, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
        '(?m)^- (.+)$', '<li>\\1</li>', 'g') || '</ul></p>' else '<p>' || reminders || '</p>' end as html
    from d"""))
def _(spark, sf):
    rows = digest.digest_join(dd.digest_blocks(*_sources(spark, sf), AS_OF, ACCOUNT), ACCOUNT)
    text = F.concat_ws("\n\n", "emails", "events", "reminders", "messages")
    return rows.select("account_id", reports.digest_report(text, AS_OF).alias("report"), markdown_to_html("reminders").alias("html"))
