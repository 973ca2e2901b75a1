"""The given tables seen as feeds: once in Spark, once in SQL.

All times are moved so that one moment, ``AS_OF``, fits every feed.  Accounts are
numbers derived from the keys.  Missing and empty fields are set by rule, so that
fall-backs and defaults have work to do on every table size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC
START = 1704067200  # 2024-01-01 00:00:00 UTC
MONTH = 2592000
ACCOUNT = ["account_id"]
ACCOUNTS = 100
# Days from the first of June 1997 to AS_OF.
ORDER_SHIFT = 9740
EVENT_SHIFT = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # All expectations are in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1048576 + (1048575 - turn) as seq",
        f"conv_id % {ACCOUNTS} as account_id",
        "conv_id as chat_seq",
        "case when conv_id % 5 = 0 then '' else cast(conv_id as string) end as chat_id",
        "case when conv_id % 4 = 0 then '' else concat('conv-', conv_id) end as chat_name",
        "case when role = 'user' then '' else role end as sender",
        "case when role = 'user' then 'Outgoing' else 'incoming' end as direction",
        f"{START} + (conv_id * 104729) % {MONTH} + turn * 60 as timestamp",
        "text",
    ).withColumn("date", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss"))


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id as seq",
        f"doc_id % {ACCOUNTS} as account_id",
        "case when doc_id % 97 <> 0 then cast(doc_id as string) end as id",
        f"timestamp_seconds({START} + (doc_id * 7919) % {MONTH}) as date",
        "case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then '' else source end as `from`",
        "case when doc_id % 17 <> 0 then substring(text, 1, 60) end as subject",
        "text as body",
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        events.join(customer, F.col("user_id") == F.col("c_custkey"), "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .withColumn("start", F.col("ts").cast("timestamp") + F.expr(f"interval {EVENT_SHIFT} days"))
        .selectExpr(
            "event_id as seq",
            f"user_id % {ACCOUNTS} as account_id",
            "cast(event_id as string) as id",
            "case when event_id % 7 <> 0 then event_type end as title",
            "start",
            "start + interval 1 hour as `end`",
            "unix_timestamp(start) as start_ts",
            "unix_timestamp(start) + 3600 as end_ts",
            "case when event_id % 3 = 0 then '' else n_name end as location",
            "case when event_id % 2 = 0 then props end as notes",
            "concat('user-', user_id) as calendar",
        )
    )


def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .withColumn("due", F.expr(
            f"case when o_orderkey % 23 <> 0 then cast(o_orderdate as timestamp) + interval {ORDER_SHIFT} days end"
        ))
        .selectExpr(
            "o_orderkey as seq",
            f"o_custkey % {ACCOUNTS} as account_id",
            "cast(o_orderkey as string) as id",
            "case when o_orderkey % 29 <> 0 then concat('Order ', o_orderkey) end as title",
            "due",
            "unix_timestamp(due) as due_ts",
            "case when o_orderkey % 2 = 0 then concat('total ', cast(o_totalprice as bigint)) else '' end as notes",
            "o_orderpriority as list",
            "o_orderstatus = 'F' as completed",
        )
    )


def message_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """message, handle, chat_message_join and chat with nanosecond dates from 2001."""
    return {
        "message": table(spark, sf_dir, "events").selectExpr(
            f"user_id % {ACCOUNTS} as account_id",
            "event_id as rowid",
            "(unix_micros(cast(ts as timestamp)) - 978307200000000L) * 1000L as date",
            "case when event_type = 'error' then '' else event_type end as text",
            "case when event_type = 'click' then 1 else 0 end as is_from_me",
            "user_id as handle_id",
        ),
        "handle": table(spark, sf_dir, "customer").selectExpr(
            f"c_custkey % {ACCOUNTS} as account_id",
            "c_custkey as rowid",
            "case when c_mktsegment <> 'HOUSEHOLD' then c_name end as id",
        ),
        "chat_message_join": table(spark, sf_dir, "lineitem").selectExpr(
            "l_orderkey as message_id", "l_suppkey as chat_id"
        ).distinct(),
        "chat": table(spark, sf_dir, "supplier").selectExpr(
            "s_suppkey as rowid", "s_name as chat_identifier",
            "case when s_nationkey % 3 = 0 then '' else concat('Room ', s_nationkey) end as display_name",
        ),
    }


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return labels.join(documents, "doc_id", "left").selectExpr(
        "doc_id + 1 as id",
        "cast(doc_id as string) as email_id",
        "substring(text, 1, 60) as subject",
        "source as sender",
        "'2024' as email_date",
        "text as body",
        "concat('q', quality) as summary",
        "concat('m', toxic) as model_used",
        f"timestamp_seconds({AS_OF} - doc_id * 60) as created_at",
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "cast(conv_id as string) as conv_id", "turn",
        "case when turn = 0 then upper(role) else role end as role", "text as content",
    )


def email_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary request per mail; some without body."""
    return emails(spark, sf_dir).selectExpr(
        "seq", "id as email_id", "subject", "`from` as sender",
        "date_format(date, 'yyyy-MM-dd HH:mm:ss') as email_date",
        "case when seq % 31 = 0 then '' else body end as body",
    )


def item_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every kind about every conversation turn; some are not complete."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1048576 + turn as seq",
        "case (conv_id + turn) % 6 when 0 then 'calendar' when 1 then 'reminder' when 2 then 'messages' "
        "when 3 then 'other' when 4 then '' end as kind",
        "concat('conv-', conv_id) as title",
        "case when turn % 3 = 2 then '' else text end as content",
        "case when turn % 4 = 3 then null else role end as question",
    )


# The same feeds in SQL -------------------------------------------------------------

_FORMAT = "'%Y-%m-%d %H:%M:%S'"


def sql_time(epoch: str) -> str:
    return f"strftime(make_timestamp(cast(({epoch}) * 1000000 as bigint)), {_FORMAT})"


CTES = {
    "f_messages": f"""
        select *, {sql_time('timestamp')} as date from (
          select conv_id * 1048576 + (1048575 - turn) as seq, conv_id % {ACCOUNTS} as account_id,
            conv_id as chat_seq,
            case when conv_id % 5 = 0 then '' else cast(conv_id as varchar) end as chat_id,
            case when conv_id % 4 = 0 then '' else 'conv-' || conv_id end as chat_name,
            case when role = 'user' then '' else role end as sender,
            case when role = 'user' then 'Outgoing' else 'incoming' end as direction,
            {START} + (conv_id * 104729) % {MONTH} + turn * 60 as timestamp, text
          from conversations)""",
    "f_emails": f"""
        select doc_id as seq, doc_id % {ACCOUNTS} as account_id,
          case when doc_id % 97 <> 0 then cast(doc_id as varchar) end as id,
          {START} + (doc_id * 7919) % {MONTH} as date_ts,
          {sql_time(f'{START} + (doc_id * 7919) % {MONTH}')} as date_text,
          case when doc_id % 11 = 0 then null when doc_id % 13 = 0 then '' else source end as "from",
          case when doc_id % 17 <> 0 then substring(text, 1, 60) end as subject,
          text as body
        from documents""",
    "f_calendar": f"""
        select event_id as seq, user_id % {ACCOUNTS} as account_id, cast(event_id as varchar) as id,
          case when event_id % 7 <> 0 then event_type end as title,
          epoch_us(ts) + {EVENT_SHIFT} * 86400000000 as start_us,
          (epoch_us(ts) + {EVENT_SHIFT} * 86400000000) // 1000000 as start_ts,
          (epoch_us(ts) + {EVENT_SHIFT} * 86400000000) // 1000000 + 3600 as end_ts,
          strftime(ts + interval {EVENT_SHIFT} day, {_FORMAT}) as start_text,
          strftime(ts + interval {EVENT_SHIFT} day + interval 1 hour, {_FORMAT}) as end_text,
          case when event_id % 3 = 0 then '' else n_name end as location,
          case when event_id % 2 = 0 then props end as notes,
          'user-' || user_id as calendar
        from events left join customer on user_id = c_custkey left join nation on c_nationkey = n_nationkey""",
    "f_reminders": f"""
        select o_orderkey as seq, o_custkey % {ACCOUNTS} as account_id, cast(o_orderkey as varchar) as id,
          case when o_orderkey % 29 <> 0 then 'Order ' || o_orderkey end as title,
          case when o_orderkey % 23 <> 0 then epoch_us(o_orderdate) // 1000000 + {ORDER_SHIFT} * 86400 end as due_ts,
          case when o_orderkey % 23 <> 0 then strftime(o_orderdate + interval {ORDER_SHIFT} day, {_FORMAT}) end as due_text,
          case when o_orderkey % 2 = 0 then 'total ' || cast(trunc(o_totalprice) as bigint) else '' end as notes,
          o_orderpriority as list, o_orderstatus = 'F' as completed
        from orders""",
    "t_message": f"""
        select user_id % {ACCOUNTS} as account_id, event_id as rowid, (epoch_us(ts) - 978307200000000) * 1000 as date,
          case when event_type = 'error' then '' else event_type end as text,
          case when event_type = 'click' then 1 else 0 end as is_from_me, user_id as handle_id
        from events""",
    "t_handle": f"""
        select c_custkey % {ACCOUNTS} as account_id, c_custkey as rowid,
          case when c_mktsegment <> 'HOUSEHOLD' then c_name end as id from customer""",
    "t_link": "select distinct l_orderkey as message_id, l_suppkey as chat_id from lineitem",
    "t_chat": """
        select s_suppkey as rowid, s_name as chat_identifier,
          case when s_nationkey % 3 = 0 then '' else 'Room ' || s_nationkey end as display_name from supplier""",
    "f_summaries": f"""
        select l.doc_id + 1 as id, cast(l.doc_id as varchar) as email_id, substring(text, 1, 60) as subject,
          source as sender, '2024' as email_date, text as body, 'q' || quality as summary,
          'm' || toxic as model_used, {AS_OF} - l.doc_id * 60 as created_ts
        from labels l left join documents d on l.doc_id = d.doc_id""",
    "f_turns": """
        select cast(conv_id as varchar) as conv_id, turn,
          case when turn = 0 then upper(role) else role end as role, text as content
        from conversations""",
    "f_requests": """
        select seq, id as email_id, subject, "from" as sender, date_text as email_date,
          case when seq % 31 = 0 then '' else body end as body
        from f_emails""",
    "f_items": """
        select conv_id * 1048576 + turn as seq,
          case (conv_id + turn) % 6 when 0 then 'calendar' when 1 then 'reminder' when 2 then 'messages'
            when 3 then 'other' when 4 then '' end as kind,
          'conv-' || conv_id as title,
          case when turn % 3 = 2 then '' else text end as content,
          case when turn % 4 = 3 then null else role end as question
        from conversations""",
}
_NEEDS = {"f_requests": ["f_emails"]}


def with_ctes(names: str, body: str) -> str:
    """``body`` after the feeds it needs (names separated by blanks)."""
    wanted: list[str] = []
    for name in names.split():
        for part in [*_NEEDS.get(name, []), name]:
            if part not in wanted:
                wanted.append(part)
    ctes = ", ".join(f"{name} as ({CTES[name]})" for name in wanted)
    text = body.strip()
    if text.lower().startswith("with "):
        return f"with {ctes}, {text[5:]}"
    return f"with {ctes} {text}"


def first_truthy(*values: str) -> str:
    *early, last = values
    return "coalesce(" + ", ".join([f"nullif({v}, '')" for v in early] + [last]) + ")"


THREAD_KEY = first_truthy("chat_id", "chat_name", "sender", "'unknown'")
THREAD_TITLE = first_truthy("chat_name", "sender", "'Unknown'")
WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
