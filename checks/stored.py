"""The summary table: look-ups, changes, and jobs that generate."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold import fixed
from feedfold.functions.prompts import email_prompt
from feedfold.operators import filters, generation, ranking, summaries as ops
from feedfold.plans import answers, mail, summarize
from feedfold.session import scratch_path
from feedfold.sources import frames
from feedfold.sources.store import SummaryStore

from . import adapters as a
from .adapters import ACCOUNT, AS_OF, with_ctes
from .models import broken_model, budget_model, length_model, odd_model, talkative_model
from .texts import (
    EMAIL_PROMPT, ITEM_CONTEXT, ITEM_PROMPT, QUESTIONS_SQL, email_context_sql, email_questions, question_sql,
)

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def _shown(df):
    """Stored rows with their time as epoch seconds."""
    return df.withColumn("created_ts", F.unix_timestamp("created_at")).drop("created_at")


_STORED = "id, email_id, subject, sender, email_date, body, summary, model_used, created_ts"


def _new(spark, sf):
    """New summaries for the mails of the last ten days; keys come twice."""
    mails = filters.look_back(a.emails(spark, sf), AS_OF, 240)
    rows = mails.selectExpr(
        "seq", "id as email_id", "subject", "`from` as sender",
        "date_format(date, 'yyyy-MM-dd HH:mm:ss') as email_date", "body",
        "concat('new ', seq) as summary", "'m2' as model_used", f"timestamp_seconds({AS_OF}) as created_at")
    again = rows.withColumns({"seq": F.col("seq") + 1_000_000, "summary": F.concat("summary", F.lit(" again"))})
    return rows.unionByName(again.where("subject is not null"))


_NEW = f"""
    n0 as (select seq, id as email_id, subject, "from" as sender, date_text as email_date, body, 'new ' || seq as summary
           from f_emails where date_ts > {AS_OF} - 240 * 3600),
    n1 as (select * from n0 union all select * replace (seq + 1000000 as seq, summary || ' again' as summary) from n0 where subject is not null),
    nth as (select *, row_number() over (order by seq) as nth from n1),
    n2 as (select * from nth where email_id is null or (email_id, seq) in (select (email_id, max(seq)) from n1 group by email_id)),
    fresh as (select (select max(id) from f_summaries) + nth as id, email_id, subject, sender, email_date,
              body, summary, 'm2' as model_used, {AS_OF} as created_ts from n2)"""


@query("has_summary", with_ctes("f_emails f_summaries", """
    select seq, exists (select 1 from f_summaries s where s.email_id = coalesce(e.id, '')) as has_summary from f_emails e"""))
def _(spark, sf):
    return ops.with_has_summary(a.emails(spark, sf), a.summaries(spark, sf)).select("seq", "has_summary")


@query("recent_emails", with_ctes("f_emails f_summaries", f"""
    select account_id, seq, rank, exists (select 1 from f_summaries s where s.email_id = coalesce(e.id, '') and s.id % 3 <> 0) as has_summary
    from (select *, row_number() over (partition by account_id order by seq) as rank from f_emails
          where date_ts > {AS_OF} - 720 * 3600) e where rank <= 10"""))
def _(spark, sf):
    # A third of the summaries is of another account than the mail with their id, and is not found.
    owner = F.expr("(id - 1) % 100 + if(id % 3 = 0, 1, 0)")
    found = mail.recent_emails(a.emails(spark, sf), a.summaries(spark, sf).withColumn("account_id", owner), AS_OF, 720, 10, ACCOUNT)
    return found.select("account_id", "seq", F.col("rank").cast("bigint").alias("rank"), "has_summary")


@query("cache_lookup", with_ctes("f_requests f_summaries", """
    select r.seq, s.summary, s.email_id is not null as cached from f_requests r left join f_summaries s on r.email_id = s.email_id"""))
def _(spark, sf):
    found = ops.cache_lookup(a.email_requests(spark, sf), a.summaries(spark, sf))
    return found.select("seq", "summary", "cached")


@query("cache_misses", with_ctes("f_requests f_summaries", """
    select seq from f_requests r where not exists (select 1 from f_summaries s where s.email_id = r.email_id)"""))
def _(spark, sf):
    return ops.cache_misses(a.email_requests(spark, sf), a.summaries(spark, sf)).select("seq")


@query("select_by_id", with_ctes("f_emails f_summaries", f"""
    select id, subject from f_emails where date_ts > {AS_OF} - 480 * 3600
      and id in (select email_id from f_summaries where model_used = 'm0')"""))
def _(spark, sf):
    refreshed = filters.look_back(a.emails(spark, sf), AS_OF, 480)
    chosen = a.summaries(spark, sf).where("model_used = 'm0'").select(F.col("email_id").alias("id"))
    return ops.select_by_id(refreshed, chosen).select("id", "subject")


@query("latest_summaries", with_ctes("f_summaries", """
    select id, email_id, subject, sender, email_date, summary, model_used, created_ts, rank from (
      select *, row_number() over (order by created_ts desc, id desc) as rank from f_summaries) where rank <= 100"""))
def _(spark, sf):
    top = ranking.latest_summaries(a.summaries(spark, sf), 100)
    return _shown(top).withColumn("rank", F.col("rank").cast("bigint"))


@query("store_snapshot", with_ctes("f_summaries", f"select {_STORED} from f_summaries"))
def _(spark, sf):
    store = SummaryStore(spark, scratch_path(spark, "store"))
    store.write(a.summaries(spark, sf))
    return _shown(store.read())


@query("insert_summaries", with_ctes("f_summaries f_emails", f"""
    with n as (select seq, id as email_id, subject, "from" as sender, date_text as email_date, body from f_emails
               where id is null or id not in (select email_id from f_summaries))
    select {_STORED} from f_summaries
    union all
    select (select max(id) from f_summaries) + row_number() over (order by seq), email_id, subject, sender, email_date, body,
      'new', 'm2', {AS_OF} from n"""))
def _(spark, sf):
    store = a.summaries(spark, sf)
    new = ops.cache_misses(a.email_requests(spark, sf).drop("body").join(
        a.emails(spark, sf).select("seq", "body"), "seq"), store)
    new = new.withColumns({"summary": F.lit("new"), "model_used": F.lit("m2"),
                           "created_at": F.timestamp_seconds(F.lit(AS_OF))})
    return _shown(ops.insert_summaries(store, new))


@query("upsert_summaries", with_ctes("f_summaries f_emails", f"""
    with {_NEW}
    select {_STORED} from f_summaries where email_id not in (select email_id from fresh where email_id is not null)
    union all select {_STORED} from fresh"""))
def _(spark, sf):
    return _shown(ops.upsert_summaries(a.summaries(spark, sf), _new(spark, sf)))


@query("store_upsert", with_ctes("f_summaries f_emails", f"""
    with {_NEW}
    select {_STORED} from f_summaries where email_id not in (select email_id from fresh where email_id is not null)
    union all select {_STORED} from fresh"""))
def _(spark, sf):
    store = SummaryStore(spark, scratch_path(spark, "store"))
    store.write(a.summaries(spark, sf))
    store.upsert(_new(spark, sf), "a")
    store.upsert(_new(spark, sf), "a")  # repeated: no effect
    return _shown(store.read())


@query("delete_summaries", with_ctes("f_summaries", f"select {_STORED} from f_summaries where model_used <> 'm1'"))
def _(spark, sf):
    store = a.summaries(spark, sf)
    gone = store.where("model_used = 'm1'").select("id")
    # Ids that are not stored do nothing.
    return _shown(ops.delete_summaries(store, gone.unionByName(gone.selectExpr("-id as id"))))


@query("clear_summaries", with_ctes("f_summaries", """
    select (select max(id) from f_summaries) + row_number() over (order by id) as id, email_id,
      subject, sender, email_date, body, summary, model_used, created_ts from f_summaries where model_used = 'm1'"""))
def _(spark, sf):
    # Filled, cleared, and filled again: nothing is left of the first rows but that their ids are used up.
    store = SummaryStore(spark, scratch_path(spark, "store"))
    table = a.summaries(spark, sf)
    store.write(table)
    store.clear()
    store.insert(table.where("model_used = 'm1'").withColumn("seq", F.col("id")).drop("id"))
    return _shown(store.read())


# Every mail id is in two accounts: what is stored for one is nothing to the other.
_TWO = {"account_id": "bigint"}
_TWO_SQL = """
    s2 as (select 1 as account_id, * from f_summaries union all
           select 2, * replace (id + 1000000000 as id, summary || ' two' as summary) from f_summaries where model_used = 'm0'),
    r2 as (select 1 as account_id, * from f_requests union all select 2, * replace (seq + 1000000000 as seq) from f_requests)"""


def _twice(df, number, ids):
    one = df.withColumn("account_id", F.lit(1).cast("bigint"))
    return one.unionByName(one.withColumns({"account_id": F.lit(2).cast("bigint"), number: F.col(number) + 1_000_000_000}).where(ids))


def _accounts(spark, sf):
    stored = _twice(a.summaries(spark, sf), "id", "model_used = 'm0'")
    stored = stored.withColumn("summary", F.when(F.col("account_id") == 2, F.concat("summary", F.lit(" two"))).otherwise(F.col("summary")))
    return stored, _twice(a.email_requests(spark, sf), "seq", "true")


@query("cache_lookup_by_account", with_ctes("f_requests f_summaries", f"""
    with {_TWO_SQL} select r.account_id, r.seq, s.summary, s.email_id is not null as cached
    from r2 r left join s2 s on r.email_id = s.email_id and r.account_id = s.account_id"""))
def _(spark, sf):
    stored, requests = _accounts(spark, sf)
    found = ops.cache_lookup(requests, stored, ACCOUNT)
    return found.select(F.col("account_id").cast("int").alias("account_id"), "seq", "summary", "cached")


@query("store_upsert_by_account", with_ctes("f_requests f_summaries", f"""
    with {_TWO_SQL}, n as (select * from r2 where email_id is not null and account_id = 2)
    select account_id, email_id, summary from s2 s where not exists (select 1 from n where n.email_id = s.email_id and n.account_id = s.account_id)
    union all select account_id, email_id, 'new ' || seq from n"""))
def _(spark, sf):
    stored, requests = _accounts(spark, sf)
    store = SummaryStore(spark, scratch_path(spark, "store"), _TWO)
    store.write(stored)
    new = requests.where("email_id is not null and account_id = 2").withColumns({
        "summary": F.concat(F.lit("new "), "seq"), "model_used": F.lit("m2"), "created_at": F.timestamp_seconds(F.lit(AS_OF))})
    store.upsert(new)
    store.delete(stored.selectExpr("-id as id"))  # ids that are not there
    return store.read().select(F.col("account_id").cast("int").alias("account_id"), "email_id", "summary")


# All requests look their mails up in a store that was folded and changed afterwards.
@query("store_look_up", with_ctes("f_requests f_summaries", f"""
    with {_TWO_SQL} select r.account_id, r.seq, case when s.model_used = 'm1' then 'again' else s.summary end as summary, s.email_id is not null as cached
    from r2 r left join s2 s on r.email_id = s.email_id and r.account_id = s.account_id"""))
def _(spark, sf):
    stored, requests = _accounts(spark, sf)
    store = SummaryStore(spark, scratch_path(spark, "store"), _TWO)
    store.write(stored)
    store.upsert(stored.where("model_used = 'm1'").withColumns({"seq": F.col("id"), "summary": F.lit("again")}))
    store.fold()
    found = ops.cache_lookup(requests, store.read_for(requests), ACCOUNT)
    return found.select(F.col("account_id").cast("int").alias("account_id"), "seq", "summary", "cached")


@query("priority_union", """
    with l as (
      select 0 as priority, s_suppkey as seq, 's' || s_nationkey as value from supplier
      union all select 1, event_id, event_type from events
      union all select 2, doc_id, trim(case when doc_id % 5 = 0 then '  ' else ' ' || source || ' ' end) from documents
      union all select 3, conv_id * 1048576 + turn, role from conversations),
    k as (select * from l where value <> ''),
    c as (select * from k union all select -1, 0, n_name from nation where n_nationkey = (select min(n_nationkey) from nation))
    select value, priority, seq from (select *, row_number() over (partition by value order by priority, seq) as r from c) where r = 1""")
def _(spark, sf):
    t = lambda name, *exprs: a.table(spark, sf, name).selectExpr(*exprs)
    nation = a.table(spark, sf, "nation")
    current = nation.where(F.col("n_nationkey") == nation.agg(F.min("n_nationkey").alias("k")).scalar())
    found = ops.priority_union([
        t("supplier", "s_suppkey as seq", "concat('s', s_nationkey) as value"),
        t("events", "event_id as seq", "event_type as value"),
        t("documents", "doc_id as seq", "case when doc_id % 5 = 0 then '  ' else concat(' ', source, ' ') end as value"),
        t("conversations", "conv_id * 1048576 + turn as seq", "role as value"),
    ], current.selectExpr("0L as seq", "n_name as value"))
    return found.select("value", "priority", "seq")


# Generation ------------------------------------------------------------------------

@query("generate", with_ctes("f_emails", f"""
    with p as (select seq, {EMAIL_PROMPT} as prompt from f_emails)
    select seq, 'Summary of ' || length(prompt) || ' characters.' as answer,
      'Budget ' || least(2048, greatest(128, greatest(1, length(prompt) // 4) // 2)) as budget from p"""))
def _(spark, sf):
    asked = a.emails(spark, sf).select("seq", email_prompt().alias("prompt"))
    first = generation.generate(asked, length_model)
    return generation.generate(first, budget_model, output="budget").drop("prompt")


@query("generate_with_fallback", with_ctes("f_emails", f"""
    with p as (select seq, length({EMAIL_PROMPT}) as n from f_emails)
    select seq, case when seq % 3 = 0 then 'Summary of ' || n || ' characters.' when n % 2 = 1 then 'Odd ' || n
        else 'Summary of ' || n || ' characters.' end as answer,
      case when seq % 3 = 0 then 'length' when n % 2 = 1 then 'odd' else 'length' end as model_used,
      null :: varchar as error from p"""))
def _(spark, sf):
    asked = a.emails(spark, sf).select(
        "seq", email_prompt().alias("prompt"), F.expr("case seq % 3 when 0 then 'length' when 1 then 'gone' end").alias("model"))
    models = {"broken": broken_model, "odd": odd_model, "length": length_model}
    made = generation.generate_with_fallback(asked, models, chosen="model")
    return made.select("seq", "answer", "model_used", "error")


@query("first_answer", with_ctes("f_emails", f"""
    select seq, case when seq % 2 = 1 then 'one' when seq % 3 = 0 then 'two' end as answer,
      case when seq % 2 = 1 then 'a' when seq % 3 = 0 then 'b' end as model_used,
      case when seq % 2 = 0 and seq % 3 <> 0 then '{fixed.ALL_MODELS_FAILED}' end as error from f_emails"""))
def _(spark, sf):
    rows = a.emails(spark, sf).selectExpr(
        "seq", "case when seq % 2 = 1 then 'one' else '' end as o1", "case when seq % 3 = 0 then 'two' end as o2")
    answer, name, error = generation.first_answer({"a": "o1", "b": "o2"})
    return rows.select("seq", answer.alias("answer"), name.alias("model_used"), error.alias("error"))


_SUMMARIZED = f"""
    with p as (select r.seq, r.email_id, r.body, s.summary as stored, s.email_id is not null as hit, length({EMAIL_PROMPT.replace('body', 'r.body')}) as n
               from f_requests r left join f_summaries s on r.email_id = s.email_id)
    select seq, email_id, case when body = '' then null when hit then stored else 'Summary of ' || n || ' characters.' end as summary,
      case when body <> '' and not hit then 'length' end as model_used, body <> '' and hit as cached,
      case when body = '' then '{fixed.ERROR_NO_BODY}' end as error from p"""


@query("summarize_job", with_ctes("f_requests f_summaries", _SUMMARIZED))
def _(spark, sf):
    store = SummaryStore(spark, scratch_path(spark, "store"))
    store.write(a.summaries(spark, sf))
    return summarize.summarize_emails(a.email_requests(spark, sf), store, {"length": length_model}, AS_OF)


@query("summarize_job_in_chunks", with_ctes("f_requests f_summaries", _SUMMARIZED))
def _(spark, sf):
    store = SummaryStore(spark, scratch_path(spark, "store"))
    store.write(a.summaries(spark, sf))
    return summarize.summarize_emails(
        a.email_requests(spark, sf), store, {"length": length_model}, AS_OF, tag="requests", chunk_rows=summarize.CHUNK_ROWS)


@query("summarize_job_by_account", with_ctes("f_requests f_summaries", f"""
    with {_TWO_SQL}, p as (select r.account_id, r.seq, r.email_id, r.body, s.summary as stored, s.email_id is not null as hit,
        length({EMAIL_PROMPT.replace('body', 'r.body')}) as n
      from r2 r left join s2 s on r.email_id = s.email_id and r.account_id = s.account_id)
    select account_id, seq, email_id, case when body = '' then null when hit then stored else 'Summary of ' || n || ' characters.' end as summary,
      case when body <> '' and not hit then 'length' end as model_used, body <> '' and hit as cached,
      case when body = '' then '{fixed.ERROR_NO_BODY}' end as error from p"""))
def _(spark, sf):
    stored, requests = _accounts(spark, sf)
    store = SummaryStore(spark, scratch_path(spark, "store"), _TWO)
    store.write(stored)
    made = summarize.summarize_emails(requests, store, {"length": length_model}, AS_OF)
    return made.withColumn("account_id", F.col("account_id").cast("int"))


@query("summarize_items", with_ctes("f_items", f"""
    with p as (select seq, kind, content, length({ITEM_PROMPT}) as n from f_items)
    select seq, case when kind in ('calendar', 'reminder', 'messages') and content <> '' then 'Summary of ' || n || ' characters.' end as summary,
      case when kind in ('calendar', 'reminder', 'messages') and content <> '' then 'length' end as model_used,
      case when coalesce(kind, '') = '' or content = '' then '{fixed.ERROR_ITEM}'
        when kind not in ('calendar', 'reminder', 'messages') then '{fixed.ERROR_KIND}' || kind end as error from p"""))
def _(spark, sf):
    made = summarize.summarize_items(a.item_requests(spark, sf), {"length": length_model})
    return made.select("seq", "summary", "model_used", "error")


_TALK = "'It has ' || length({p}) || ' characters. Two. Three. Four.'"


@query("answer_job", with_ctes("f_turns f_emails f_summaries f_items", f"""
    with q as ({QUESTIONS_SQL}),
      p as (select conv_id || '/' || turn as key, {question_sql(fixed.EMAIL_QUESTION_SYSTEM, email_context_sql('body', 'summary', 'conversation'), 'question')} as p from q
            union all
            select 'item/' || seq, {question_sql(fixed.ITEM_QUESTION_SYSTEM, ITEM_CONTEXT, 'question')} from f_items
            where kind <> '' and content <> '' and question <> '')
    select key, 0 as frame_no, to_json({{'type': 'chunk', 'content': {_TALK.format(p='p')}}}) :: varchar as frame from p
    union all select key, 1, to_json({{'type': 'done'}}) :: varchar from p
    union all select 'item/' || seq, 0, to_json({{'type': 'error', 'content': '{fixed.ERROR_ITEM_QUESTION}'}}) :: varchar from f_items
      where coalesce(kind, '') = '' or coalesce(content, '') = '' or coalesce(question, '') = ''"""))
def _(spark, sf):
    mails = email_questions(spark, sf).withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    items = a.item_requests(spark, sf).withColumn("key", F.concat(F.lit("item/"), F.col("seq")))
    one = answers.answer_email_questions(mails, talkative_model, batch=False)
    two = answers.answer_item_questions(items, talkative_model, batch=False)
    return frames.answer_frames(one, ["key"]).unionByName(frames.answer_frames(two, ["key"]))


@query("answer_batch", with_ctes("f_turns f_emails f_summaries", f"""
    with q as ({QUESTIONS_SQL}),
      p as (select conv_id, turn, {question_sql(fixed.EMAIL_QUESTION_SYSTEM, email_context_sql('body', 'summary', 'conversation'), 'question')} as p from q)
    select conv_id, turn, case when length(p) % 2 = 1 then 'Odd ' || length(p) end as answer,
      case when length(p) % 2 = 0 then '{fixed.ERROR_ANSWER}' end as error from p"""))
def _(spark, sf):
    made = answers.answer_email_questions(email_questions(spark, sf), odd_model)
    return made.select("conv_id", "turn", "answer", "error")
