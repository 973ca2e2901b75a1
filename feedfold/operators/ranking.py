"""Caps, orders and running budgets.

A cap keeps the first n rows of a total order.  Without ``by`` it is a top-n
(each task keeps n rows, one small merge).  With ``by`` it is merged in two
levels: an account's rows are dealt to ``SHARES`` groups, each group keeps its
first n, and only those meet in one task.  Spark cuts small n in each task before
the first level as well; an account that holds a third of all rows is spread at
any n.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..columns import By, as_column, by_columns, quoted, window_by

Order = Sequence[Column | str]

SHARES = 64
DAY = 86_400


def first_n(df: DataFrame, n: int | None, order: Order, by: By = (), rank: str = "rank") -> DataFrame:
    """First n rows per account in ``order``, numbered from 1 in ``rank``."""
    order = [as_column(o) for o in order]
    if n is None and not by:
        raise ValueError("numbering all rows of one account would need one task; give n or by")
    if n is not None:
        # Dealt by input task, so that what each task keeps of an account is n rows, not n for each group; the last merge
        # gets n rows of each share, however many tasks there were.
        df = df.withColumn("_share", F.spark_partition_id() % SHARES)
        nth = F.row_number().over(window_by([*by, "_share"]).orderBy(*order))
        df = df.withColumn("_nth", nth).where(F.col("_nth") <= n).drop("_share", "_nth")
        if not by:
            # At most n rows are left before they are numbered.
            df = df.orderBy(*order).limit(n)
    numbered = df.withColumn(rank, F.row_number().over(window_by(by).orderBy(*order)))
    return numbered if n is None else numbered.where(F.col(rank) <= n)


def ranked(df: DataFrame, sort: str, seq: str, by: By = (), rank: str = "rank", width: int = DAY) -> DataFrame:
    """All rows numbered from 1 by (``sort``, ``seq``), NULL first, without bringing an account together.

    Rows are counted per ``width`` of ``sort`` and numbered inside it.
    """
    spanned = df.withColumn("_span", F.floor(quoted(sort) / width).cast("bigint"))
    keys = [*by, "_span"]
    counts = spanned.groupBy(*by_columns(keys)).agg(F.count(F.lit(1)).alias("_n"))
    ahead = window_by(by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).select(
        *[quoted(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_before")
    same = reduce(Column.__and__, [quoted(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    inside = F.row_number().over(window_by(keys).orderBy(quoted(sort), quoted(seq)))
    placed = spanned.withColumn("_nth", inside).join(starts, same)
    number = (F.col("_before") + F.col("_nth")).cast("int")
    return placed.withColumn(rank, number).select(*[quoted(c) for c in df.columns], rank)


def arrival_numbers(df: DataFrame, seq: str = "seq", number: str = "number") -> DataFrame:
    """All rows numbered from 1 in the order of ``seq`` (a unique bigint), however far apart its values are.

    Rows are numbered inside spans of 2**16 values.  Where a span begins is a prefix sum of counts, of spans inside spans
    of 2**32 values, of these inside spans of 2**48, and of those: no window sees more than 2**16 rows, as there
    are no more values at any level.  Rows without ``seq`` get no number; a column named ``number`` is replaced.
    """
    value = quoted(seq).cast("bigint")
    counts = df.where(value.isNotNull()).groupBy(F.shiftright(value, 16).alias("_span0")).agg(F.count(F.lit(1)).alias("_n"))
    levels = [counts]
    for level in (1, 2):
        wider = levels[-1].groupBy(F.shiftright(f"_span{level - 1}", 16).alias(f"_span{level}"))
        levels.append(wider.agg(F.sum("_n").alias("_n")))
    starts = None
    for level in (2, 1, 0):
        span, wider = f"_span{level}", F.shiftright(f"_span{level}", 16) if level < 2 else F.lit(0)
        ahead = Window.partitionBy(wider).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
        before = levels[level].select(span, wider.alias("_in"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
        if starts is None:
            starts = before.select(span, F.col("_ahead").alias("_before"))
        else:
            starts = before.join(starts, F.col("_in") == F.col(f"_span{level + 1}")).select(
                span, (F.col("_ahead") + F.col("_before")).alias("_before"))
    starts = starts.withColumnRenamed("_span0", "_starts")
    placed = df.withColumn("_span", F.shiftright(value, 16))
    placed = placed.withColumn("_nth", F.row_number().over(Window.partitionBy("_span").orderBy(quoted(seq))))
    placed = placed.join(starts, F.col("_span") == F.col("_starts"), "left")
    return placed.select(*[quoted(c) for c in df.columns if c != number], (F.col("_before") + F.col("_nth")).alias(number))


def cap_by_arrival(df: DataFrame, n: int, by: By = (), seq: str = "seq") -> DataFrame:
    """The n rows that came first."""
    return first_n(df, n, [seq], by)


def cap_then_sort(df: DataFrame, n: int, by: By = (), sort: str = "due_ts", seq: str = "seq") -> DataFrame:
    """The n rows that came first, ``rank`` following ``sort``: not the n smallest."""
    capped = first_n(df, n, [seq], by)
    order = window_by(by).orderBy(quoted(sort), quoted(seq))
    return capped.withColumn("rank", F.row_number().over(order))


def sort_then_cap(df: DataFrame, n: int, by: By = (), sort: str = "start_ts", seq: str = "seq") -> DataFrame:
    """The n smallest by ``sort``, a number of seconds; ``n=0`` keeps all rows, ranked as well."""
    return first_n(df, n, [sort, seq], by) if n else ranked(df, sort, seq, by)


def cap_across_groups(df: DataFrame, n: int, by: By = (), group_order: str = "chat_seq",
                      ts: str = "timestamp", seq: str = "seq") -> DataFrame:
    """One cap eaten up chat by chat in chat order, newest first inside a chat."""
    return first_n(df, n, [group_order, F.desc(ts), seq], by)


def newest_n(df: DataFrame, n: int, by: By = (), ts: str = "date", seq: str = "seq") -> DataFrame:
    return first_n(df, n, [F.desc(ts), seq], by)


def as_arrival_order(capped: DataFrame, rank: str = "rank", seq: str = "seq") -> DataFrame:
    """Make the rank of a cap the arrival order of what follows."""
    return capped.withColumn(seq, F.col(rank).cast("bigint")).drop(rank)


def threads_by_recency(threads: DataFrame, by: By = ()) -> DataFrame:
    """Latest thread first; equal times keep the order of first appearance.

    With accounts each account's rows, which a cap has made few, are put in order together; accounts are in no
    order, so nothing is sorted as a whole and lists are not moved for it again.
    """
    if by:
        return threads.repartition(*by_columns(by)).sortWithinPartitions(*by_columns(by), F.desc("last_ts"), "first_seq")
    return threads.orderBy(F.desc("last_ts"), "first_seq")


def threads_by_volume(threads: DataFrame, n: int, by: By = ()) -> DataFrame:
    """The n threads with most messages; equal counts keep the order of first appearance."""
    return first_n(threads, n, [F.desc("message_count"), "first_seq"], by)


def latest_summaries(summaries: DataFrame, n: int, by: By = ()) -> DataFrame:
    """Newest stored summaries without their bodies; equal times put the higher id first."""
    narrow = summaries.select(
        *by_columns(by), "id", "email_id", "subject", "sender", "email_date",
        "summary", "model_used", "created_at",
    )
    return first_n(narrow, n, [F.desc("created_at"), F.desc("id")], by)


def keep_first(df: DataFrame, key: Order, order: Order) -> DataFrame:
    """One row per key: the first in ``order``."""
    window = Window.partitionBy(*[as_column(k) for k in key]).orderBy(*[as_column(o) for o in order])
    return df.withColumn("_nth", F.row_number().over(window)).where("_nth = 1").drop("_nth")


def char_budget(ranked: DataFrame, max_chars: int, rows: int, by: By = (),
                line: str = "line", rank: str = "rank") -> DataFrame:
    """The longest run of leading lines whose lengths add up to ``max_chars`` at most.

    Only the first ``rows`` ranks take part, so a window never sees more than that
    many rows.  Lengths are not negative: stopping at the first overflow and
    filtering on the running sum are the same.
    """
    leading = ranked.where(F.col(rank) <= rows)
    running = F.sum(F.length(line)).over(
        window_by(by).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return leading.withColumn("running_chars", running).where(F.col("running_chars") <= max_chars)
