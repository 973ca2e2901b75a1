"""Text operators, prompts, contexts, reports and frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedfold import fixed
from feedfold.functions import lines, prompts, text
from feedfold.operators import chat
from feedfold.operators.summaries import cache_lookup
from feedfold.session import scratch_path
from feedfold.sources import frames, reports, text_files

from . import adapters as a
from .adapters import AS_OF, WHITE, first_truthy, with_ctes

QUERIES, ORACLES = {}, {}
NL = "chr(10)"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def lit(value: str) -> str:
    """A SQL text constant."""
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, **fields: str) -> str:
    """A fixed text with fields as a SQL expression."""
    out = lit(template)
    for name, expression in fields.items():
        out = out.replace("{" + name + "}", f"' || {expression} || '")
    return out


# Lines -----------------------------------------------------------------------------

BODY_START = f"trim(replace(substring(coalesce(body, ''), 1, 200), {NL}, ' '), {WHITE})"
EMAIL_LINE = (f"'- From: ' || coalesce(\"from\", 'Unknown') || ', Subject: ' || coalesce(subject, 'No Subject') || "
              f"case when {BODY_START} <> '' then ' - ' || {BODY_START} || '...' else '' end")
EVENT_LINE = ("'- ' || coalesce(title, 'Untitled') || ' at ' || coalesce(start_text, 'TBD') || "
              "case when coalesce(location, '') <> '' then ' (' || location || ')' else '' end")
REMINDER_LINE = ("'- ' || coalesce(title, 'Untitled') || "
                 "case when due_text is not null then ' (due: ' || due_text || ')' else '' end")


@query("email_line", with_ctes("f_emails", f"select seq, {EMAIL_LINE} as line from f_emails"))
def _(spark, sf):
    return a.emails(spark, sf).select("seq", lines.email_line().alias("line"))


@query("event_line", with_ctes("f_calendar", f"select seq, {EVENT_LINE} as line from f_calendar"))
def _(spark, sf):
    return a.calendar(spark, sf).select("seq", lines.event_line().alias("line"))


@query("reminder_line", with_ctes("f_reminders", f"select seq, {REMINDER_LINE} as line from f_reminders"))
def _(spark, sf):
    return a.reminders(spark, sf).select("seq", lines.reminder_line().alias("line"))


EVENT_CONTENT = f"""concat_ws({NL}, 'Calendar: ' || {first_truthy('calendar', "'Calendar'")}, 'Start: ' || coalesce(start_text, 'Unknown'),
    'End: ' || coalesce(end_text, 'Unknown'), case when location <> '' then 'Location: ' || location end,
    case when notes <> '' then 'Notes: ' || notes end)"""
REMINDER_CONTENT = f"""concat_ws({NL}, 'List: ' || {first_truthy('list', "'Reminders'")}, 'Due: ' || coalesce(due_text, 'Today'),
    case when notes <> '' then 'Notes: ' || notes end)"""


@query("item_content", with_ctes("f_calendar f_reminders", f"""
    select 'calendar' as kind, seq, {EVENT_CONTENT} as content from f_calendar
    union all select 'reminder', seq, {REMINDER_CONTENT} from f_reminders"""))
def _(spark, sf):
    events = a.calendar(spark, sf).select(
        F.lit("calendar").alias("kind"), "seq", lines.event_content().alias("content"))
    reminders = a.reminders(spark, sf).select(
        F.lit("reminder").alias("kind"), "seq", lines.reminder_content().alias("content"))
    return events.unionByName(reminders)


# Cleaning --------------------------------------------------------------------------

# What a model might return for a document: label, text, blank lines, rulers.
_OUTPUT = "concat('Final answer: `', {text}, '`\n\n---  \n\n```\n ~~~~')"
_OUTPUT_SQL = f"('Final answer: `' || text || '`' || {NL} || {NL} || '---  ' || {NL} || {NL} || '```' || {NL} || ' ~~~~')"


def _clean_sql(t: str) -> str:
    trimmed = f"trim({t}, {WHITE})"
    tail = r"(?:(?:^|\n)[ \t]*(?:`{3,}|-{3,}|_{3,}|~{3,})?[ \t]*)+$"
    return f"trim(regexp_replace({trimmed}, '{tail}', ''), {WHITE})"


def _chat_sql(source: str, key: str, t: str) -> str:
    """``key`` and cleaned ``answer`` for the texts ``t`` of ``source``."""
    labels = "|".join(fixed.ANSWER_LABELS)
    return rf"""
    with b as (select {key}, {t} as t, {_clean_sql(t)} as c0 from {source}),
      f as (select {key}, t, c0, trim(regexp_replace(regexp_replace(replace(replace(c0, '```', ' '), '`', ''),
          '\b({labels})\s*:\s*', '', 'gi'), '\s+', ' ', 'g')) as c from b),
      s as (select *, list_filter(string_split(regexp_replace(c, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)),
          lambda x: x <> '') as ss from f)
    select {key}, case when t = '' or c0 = '' then ''
      when contains(c, 'User Question:') then rtrim(string_split(c, 'User Question:')[1])
      when contains(c, 'Question:') and contains(c, 'Answer:') then rtrim(string_split(c, 'Question:')[1])
      when len(ss) > 1 then array_to_string(list_filter(ss, lambda x, i: list_position(ss, x) = i)[1:4], ' ')
      else c end as answer from s"""


@query("strip_code_blocks", f"""
    select doc_id, trim(string_split(text || case when doc_id % 2 = 0 then '```sql' else ' ' end || text, '```')[1], {WHITE}) as text
    from documents""")
def _(spark, sf):
    docs = a.table(spark, sf, "documents").selectExpr(
        "doc_id", "concat(text, case when doc_id % 2 = 0 then '```sql' else ' ' end, text) as text")
    return docs.select("doc_id", text.strip_code_blocks("text").alias("text"))


@query("clean_response", f"""
    select doc_id, {_clean_sql(_OUTPUT_SQL)} as plain, {_clean_sql('text')} as bare from documents""")
def _(spark, sf):
    docs = a.table(spark, sf, "documents")
    output = F.expr(_OUTPUT.format(text="text"))
    return docs.select("doc_id", text.clean_response(output).alias("plain"), text.clean_response("text").alias("bare"))


@query("clean_chat_response", _chat_sql("documents", "doc_id", _OUTPUT_SQL))
def _(spark, sf):
    output = F.expr(_OUTPUT.format(text="text"))
    return a.table(spark, sf, "documents").select("doc_id", text.clean_chat_response(output).alias("answer"))


@query("chunk_text", """
    select doc_id, unnest(range(0, (length(text) + 119) // 120)) as pos,
      substring(text, unnest(range(0, (length(text) + 119) // 120)) * 120 + 1, 120) as piece from documents""")
def _(spark, sf):
    docs = a.table(spark, sf, "documents").select("doc_id", F.posexplode(text.chunks("text")).alias("pos", "piece"))
    return docs.withColumn("pos", F.col("pos").cast("bigint"))


_MARKDOWN = ("concat('## Document ', doc_id, '\n\n**', source, '** & <', lang, '>\n- ', lang, '\n- ', source, "
             "'\n\n1. first\n2. **second**\n### End\n', text)")
_MARKDOWN_SQL = (f"('## Document ' || doc_id || {NL} || {NL} || '**' || source || '** & <' || lang || '>' || {NL} || '- ' || lang || {NL} "
                 f"|| '- ' || source || {NL} || {NL} || '1. first' || {NL} || '2. **second**' || {NL} || '### End' || {NL} || text)")


def _markdown_sql(t: str) -> str:
    html = f"replace(replace(replace(replace({t}, '&', '&amp;'), chr(160), '&nbsp;'), '<', '&lt;'), '>', '&gt;')"
    for pattern, put in (
        (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"(?m)^### (.+)$", r"<h4>\1</h4>"),
        (r"(?m)^## (.+)$", r"<h3>\1</h3>"), (r"(?m)^- (.+)$", r"<li>\1</li>"),
        (r"((?:<li>.*</li>\n?)+)", r"<ul>\1</ul>"), (r"(?m)^[0-9]+\. (.+)$", r"<li>\1</li>"),
    ):
        html = f"regexp_replace({html}, '{pattern}', '{put}', 'g')"
    html = f"'<p>' || replace({html}, {NL} || {NL}, '</p><p>') || '</p>'"
    return rf"regexp_replace({html}, '<p>\s*</p>', '', 'g')"


@query("markdown_to_html", f"select doc_id, {_markdown_sql(_MARKDOWN_SQL)} as html from documents")
def _(spark, sf):
    return a.table(spark, sf, "documents").select("doc_id", text.markdown_to_html(F.expr(_MARKDOWN)).alias("html"))


# Prompts and contexts --------------------------------------------------------------

EMAIL_PROMPT = lit(fixed.EMAIL_SYSTEM + "\n\n") + " || " + filled(fixed.EMAIL_PROMPT + "\n", body="body")


@query("email_prompt", with_ctes("f_emails", f"select seq, {EMAIL_PROMPT} as prompt from f_emails"))
def _(spark, sf):
    return a.emails(spark, sf).select("seq", prompts.email_prompt("body").alias("prompt"))


ITEM_PROMPT = "case kind " + " ".join(
    f"when '{kind}' then {lit(fixed.ITEM_SYSTEM[kind])} || {NL} || {NL} || "
    + filled(template + "\n", title="title", content="content")
    for kind, template in fixed.ITEM_PROMPT.items()
) + " end"


@query("item_prompt", with_ctes("f_items", f"select seq, {ITEM_PROMPT} as prompt from f_items"))
def _(spark, sf):
    return a.item_requests(spark, sf).select("seq", prompts.item_prompt().alias("prompt"))


CONVERSATION = (f"string_agg(role || ': ' || content, {NL}) over "
                "(partition by conv_id order by turn rows between 3 preceding and current row)")


@query("chat_context", with_ctes("f_turns", f"select conv_id, turn, {CONVERSATION} as conversation from f_turns"))
def _(spark, sf):
    return chat.chat_context(a.turns(spark, sf)).select("conv_id", "turn", "conversation")


@query("chat_context_generic", with_ctes("f_turns", f"""
    select conv_id, turn, 'About ' || conv_id || {NL} || {NL} || 'Previous conversation:' || {NL} ||
      string_agg(case when lower(role) = 'user' then 'Q: ' else 'A: ' end || content, {NL})
      over (partition by conv_id order by turn rows between 3 preceding and current row) as full_context from f_turns"""))
def _(spark, sf):
    base = a.turns(spark, sf).withColumn("context", F.concat(F.lit("About "), "conv_id"))
    return chat.chat_context_generic(base).select("conv_id", "turn", "full_context")


# Events of a user as turns of one long conversation, some without user or place, worked on in spans of 1,000 places.
@query("chat_context_long", f"""
    with t as (select case when user_id % 50 <> 0 then user_id end as conv_id, case when event_id <> 11 then event_id end as turn,
        case when event_id % 9 <> 0 then event_type end as role, props as content from events)
    select conv_id, turn, string_agg(role || ': ' || content, {NL}) over (
      partition by conv_id order by turn nulls first rows between 3 preceding and current row) as conversation from t""")
def _(spark, sf):
    turns = a.table(spark, sf, "events").selectExpr(
        "case when user_id % 50 <> 0 then user_id end as conv_id", "case when event_id <> 11 then event_id end as turn",
        "case when event_id % 9 <> 0 then event_type end as role", "props as content")
    found = chat.trailing_lines(turns, F.concat("role", F.lit(": "), "content"), 4, span=1_000)
    text = F.when(F.size("_lines") > 0, F.array_join("_lines", "\n"))
    return found.select("conv_id", "turn", text.alias("conversation"))


def email_context_sql(body: str, summary: str, talk: str) -> str:
    return (f"'Email Content:' || {NL} || {body} || {NL} || {NL} || "
            f"case when coalesce({summary}, '') <> '' then 'Summary:' || {NL} || {summary} || {NL} || {NL} else '' end || "
            f"case when coalesce({talk}, '') <> '' then 'Previous conversation:' || {NL} || {talk} || {NL} || {NL} else '' end")


def question_sql(system: str, context: str, question: str) -> str:
    return lit(system) + f" || {NL} || {NL} || " + filled(
        fixed.QUESTION_PROMPT + "\n", context=f"({context})", question=question)


ITEM_CONTEXT = ("case kind when 'calendar' then 'Calendar context:' when 'reminder' then 'Reminder context:' "
                f"when 'messages' then 'Messages context:' else 'Context:' end || {NL} || content")

# A question per user turn about the mail whose number is the conversation's.
QUESTIONS_SQL = f"""
    select t.conv_id, t.turn, e.body, s.summary, t.conversation, t.content as question
    from (select *, {CONVERSATION} as conversation from f_turns) t
      join f_emails e on e.id = t.conv_id left join f_summaries s on s.email_id = e.id
    where lower(t.role) = 'user'"""


def email_questions(spark, sf):
    talk = chat.chat_context(a.turns(spark, sf)).where(F.lower("role") == "user")
    mails = a.emails(spark, sf).select(F.col("id").alias("email_id"), "body")
    known = cache_lookup(mails, a.summaries(spark, sf)).select(F.col("email_id").alias("conv_id"), "body", "summary")
    return talk.join(known, "conv_id").select(
        "conv_id", "turn", "body", "summary", "conversation", F.col("content").alias("question"))


@query("question_prompt", with_ctes("f_turns f_emails f_summaries f_items", f"""
    with q as ({QUESTIONS_SQL})
    select conv_id || '/' || turn as key, {question_sql(fixed.EMAIL_QUESTION_SYSTEM, email_context_sql('body', 'summary', 'conversation'), 'question')} as prompt from q
    union all
    select 'item/' || seq, {question_sql(fixed.ITEM_QUESTION_SYSTEM, ITEM_CONTEXT, 'question')} from f_items"""))
def _(spark, sf):
    context = prompts.email_context("body", "summary", "conversation")
    mail = email_questions(spark, sf).select(
        F.concat_ws("/", "conv_id", "turn").alias("key"),
        prompts.email_question_prompt(context, "question").alias("prompt"))
    items = a.item_requests(spark, sf).select(
        F.concat(F.lit("item/"), F.col("seq")).alias("key"),
        prompts.item_question_prompt(prompts.item_context("kind", "content"), "question").alias("prompt"))
    return mail.unionByName(items)


# Reports ---------------------------------------------------------------------------

FILE_NAME = ("'email_2024-01-31_' || substring(regexp_replace(" + first_truthy("subject", "'email'")
             + ", '[^a-zA-Z0-9]', '_', 'g'), 1, 50) || '.txt'")
_EXPORTED = "2024-01-31 00:00:00"


@query("export_file_name", with_ctes("f_emails", f"""
    select seq, {FILE_NAME} as file_name, 'daily_digest_2024-01-31.txt' as digest_name from f_emails"""))
def _(spark, sf):
    return a.emails(spark, sf).select(
        "seq", reports.email_file_name(AS_OF).alias("file_name"), reports.digest_file_name(AS_OF).alias("digest_name"))


_CHAT = "exists (select 1 from f_turns t where t.conv_id = e.id)"


_REPORT_ROWS = f"""
    select e.seq, e.id, {FILE_NAME.replace('subject', 'e.subject')} as file_name, 0 as section, null as turn,
      '=== EMAIL EXPORT ===' || {NL} || {NL} || 'Date: ' || date_text || {NL} || 'From: ' || {first_truthy('"from"', "'Unknown'")}
      || {NL} || 'Subject: ' || {first_truthy('e.subject', "'No Subject'")} || {NL} || {NL} || '--- ORIGINAL EMAIL ---' || {NL} || {NL} || e.body
      || coalesce({NL} || {NL} || '--- AI SUMMARY ---' || {NL} || {NL} || s.summary, '')
      || case when {_CHAT} then {NL} || {NL} || '--- CHAT CONVERSATION ---' || {NL} else '' end as text
    from f_emails e left join f_summaries s on s.email_id = e.id
    union all
    select e.seq, t.conv_id, {FILE_NAME.replace('subject', 'e.subject')}, 1, t.turn, t.role || ': ' || t.content || {NL}
    from f_turns t join f_emails e on e.id = t.conv_id
    union all
    select e.seq, e.id, {FILE_NAME.replace('subject', 'e.subject')}, 2, null, case when {_CHAT} then {NL} else '' end
      || '=== END OF EXPORT ===' || {NL} || 'Exported on: {_EXPORTED}' || {NL} || 'Model used: Default' from f_emails e"""


@query("export_email_text", with_ctes("f_emails f_summaries f_turns", _REPORT_ROWS))
def _(spark, sf):
    return reports.email_report(a.emails(spark, sf), a.summaries(spark, sf), AS_OF, turns=a.turns(spark, sf))


# Written, read back and put together; every 97th mail has no id.
@query("export_reports", with_ctes("f_emails f_summaries f_turns", f"""
    with r as ({_REPORT_ROWS})
    select seq, file_name, string_agg(text || {NL}, '' order by section, turn) as report from r group by seq, file_name"""))
def _(spark, sf):
    rows = reports.email_report(a.emails(spark, sf), a.summaries(spark, sf), AS_OF, turns=a.turns(spark, sf))
    path = scratch_path(spark, "reports")
    reports.write_reports(rows, path)
    return reports.report_texts(spark.read.parquet(path))


# As files: every 97th mail has no id, and mails of one subject have one file name.
@query("export_email_files", with_ctes("f_emails f_summaries f_turns", f"""
    with r as ({_REPORT_ROWS}), t as (select seq, file_name, string_agg(text || {NL}, '' order by section, turn) as report from r group by seq, file_name),
      k as (select *, min(seq) over (partition by file_name) as first from t)
    select case when seq = first then file_name else replace(file_name, '.txt', '~' || seq || '.txt') end as name, report from k"""))
def _(spark, sf):
    rows = reports.email_report(a.emails(spark, sf), a.summaries(spark, sf), AS_OF, turns=a.turns(spark, sf))
    path = scratch_path(spark, "report-files")
    text_files.write_email_reports(rows, path)
    return text_files.read_text_reports(spark, path).select("name", F.col("text").alias("report"))


@query("export_digest_files", with_ctes("f_summaries", f"""
    select model_used as account, case when id = min(id) over (partition by model_used) then 'daily_digest_{_EXPORTED[:10]}.txt'
        else 'daily_digest_{_EXPORTED[:10]}~' || id || '.txt' end as name,
      '=== DAILY DIGEST ===' || {NL} || 'Generated: {_EXPORTED}' || {NL} || 'Model: ' || model_used || {NL} || {NL}
      || repeat('=', 50) || {NL} || {NL} || body || {NL} || {NL} || repeat('=', 50) || {NL} || '=== END OF DIGEST ===' || {NL} as report
    from f_summaries"""))
def _(spark, sf):
    rows = a.summaries(spark, sf).select(F.col("model_used").alias("account"), "id", reports.digest_file_name(AS_OF).alias("file_name"),
                                         reports.digest_report("body", AS_OF, F.col("model_used")).alias("text"))
    path = scratch_path(spark, "digest-files")
    text_files.write_text_reports(rows, path, ["account"], "id")
    return text_files.read_text_reports(spark, path, ["account"]).withColumnRenamed("text", "report")


@query("export_digest_text", with_ctes("f_summaries", f"""
    select id, '=== DAILY DIGEST ===' || {NL} || 'Generated: {_EXPORTED}' || {NL} || 'Model: ' || model_used || {NL} || {NL}
      || repeat('=', 50) || {NL} || {NL} || body || {NL} || {NL} || repeat('=', 50) || {NL} || '=== END OF DIGEST ===' || {NL} as report
    from f_summaries"""))
def _(spark, sf):
    return a.summaries(spark, sf).select("id", reports.digest_report("body", AS_OF, F.col("model_used")).alias("report"))


_RESULTS = """select seq, case when seq % 31 <> 0 then body end as summary, 'm' || seq % 2 as model_used,
    seq % 3 = 0 as cached, case when seq % 31 = 0 then 'All models failed' end as error"""
PIECES = "unnest(range(0, (length({t}) + 119) // 120))"


@query("event_frames", with_ctes("f_emails", f"""
    with r as ({_RESULTS} from f_emails),
      c as (select seq, summary, model_used, (length(summary) + 119) // 120 as n from r where error is null and not cached)
    select seq, cast(p as integer) as frame_no, to_json({{'type': 'chunk', 'content': substring(summary, p * 120 + 1, 120)}}) :: varchar as frame
      from (select *, unnest(range(0, n)) as p from c)
    union all select seq, cast(n as integer), to_json({{'type': 'model', 'content': model_used}}) :: varchar from c
    union all select seq, cast(n + 1 as integer), to_json({{'type': 'done'}}) :: varchar from c
    union all select seq, 0, to_json({{'type': 'chunk', 'content': summary}}) :: varchar from r where error is null and cached
    union all select seq, 1, to_json({{'type': 'cached', 'value': true}}) :: varchar from r where error is null and cached
    union all select seq, 2, to_json({{'type': 'done'}}) :: varchar from r where error is null and cached
    union all select seq, 0, to_json({{'type': 'error', 'content': error}}) :: varchar from r where error is not null"""))
def _(spark, sf):
    results = a.emails(spark, sf).selectExpr(
        "seq", "case when seq % 31 <> 0 then body end as summary", "concat('m', seq % 2) as model_used",
        "seq % 3 = 0 as cached", "case when seq % 31 = 0 then 'All models failed' end as error")
    return frames.summary_frames(results, ["seq"])
