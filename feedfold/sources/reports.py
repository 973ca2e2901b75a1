"""Text reports of mails and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..columns import By, Instant, as_column, by_columns, instant, quoted
from ..functions.fields import date_label, first_truthy, is_truthy, iso_text
from ..operators.joins import fresh_key
from ..operators.summaries import cache_lookup


def email_file_name(as_of: Instant, subject: Column | str = "subject") -> Column:
    """``email_<UTC date>_<subject>.txt``; all but ASCII letters and digits become ``_``."""
    name = first_truthy(subject, F.lit("email"))
    # The browser counts characters beyond the basic plane twice, hence two marks.
    name = F.regexp_replace(F.regexp_replace(name, r"[\x{10000}-\x{10ffff}]", "__"), "[^A-Za-z0-9]", "_")
    return F.concat(F.lit("email_"), utc_date(as_of), F.lit("_"),
                    F.substring(name, 1, fixed.EXPORT_SUBJECT_CHARS), F.lit(".txt"))


def digest_file_name(as_of: Instant) -> Column:
    return F.concat(F.lit("daily_digest_"), utc_date(as_of), F.lit(".txt"))


def utc_date(as_of: Instant) -> Column:
    now = instant(as_of)
    return F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd")


def email_report(emails: DataFrame, summaries: DataFrame, as_of: Instant, model: str | None = None,
                 turns: DataFrame | None = None, by: By = (), key: str = "seq") -> DataFrame:
    """Reports as rows ``by, key, id, file_name, section, turn, text``.

    The rows of an account's ``key`` (unique there, also for mails without id) in order of section and turn, each
    followed by a line end, are the report: head with the mail and its stored summary, chat
    turns (``conv_id`` holds the mail's id), foot.  Turns stay rows of their own, so
    that a long conversation is never gathered into one value.
    """
    named = emails.withColumn("file_name", email_file_name(as_of))
    found = cache_lookup(named.where(F.col("id").isNotNull()).withColumn("email_id", F.col("id")), summaries, by)
    keyed = found.drop("email_id", "cached")
    if turns is None:
        keyed = keyed.withColumn("_chat", F.lit(False))
    else:
        accounts = [quoted(c).alias(f"_by{i}") for i, c in enumerate(by)]
        talked = turns.select(*accounts, fresh_key("conv_id").alias("_conv"), F.lit(True).alias("_has")).distinct()
        keyed = keyed.join(talked, _of_account(F.col("id") == F.col("_conv"), by), "left").withColumn(
            "_chat", F.coalesce("_has", F.lit(False))
        )
    # Mails without id have neither and need not meet in one partition of the joins.
    without_id = named.where(F.col("id").isNull()).withColumns({
        "summary": F.lit(None).cast("string"), "_chat": F.lit(False)})
    mails = keyed.select(*without_id.columns).unionByName(without_id)
    head = F.concat(
        F.lit(fixed.REPORT_HEAD), date_label("date"),
        F.lit("\nFrom: "), first_truthy(quoted("from"), F.lit(fixed.UNKNOWN)),
        F.lit("\nSubject: "), first_truthy("subject", F.lit(fixed.NO_SUBJECT)),
        F.lit(fixed.REPORT_MAIL), first_truthy("body", F.lit(fixed.NO_CONTENT)),
        F.when(is_truthy("summary"),
               F.concat(F.lit(fixed.REPORT_SUMMARY), F.col("summary"))).otherwise(""),
        F.when(F.col("_chat"), F.lit(fixed.REPORT_CHAT)).otherwise(""),
    )
    foot = F.concat(
        F.when(F.col("_chat"), F.lit("\n")).otherwise(""),
        F.lit(fixed.REPORT_FOOT), iso_text(instant(as_of)),
        F.lit("\nModel used: "), F.lit(model or fixed.DEFAULT_MODEL),
    )
    none = F.lit(None).cast("bigint")
    ends = F.array(
        F.struct(F.lit(0).alias("section"), none.alias("turn"), head.alias("text")),
        F.struct(F.lit(2).alias("section"), none.alias("turn"), foot.alias("text")),
    )
    rows = mails.select(*by_columns(by), key, "id", "file_name", F.inline(ends))
    if turns is None:
        return rows
    owners = named.select(*by_columns(by), key, F.col("id").alias("conv_id"), "file_name")
    talk = turns.join(owners, [*by, "conv_id"]).select(
        *by_columns(by), key, F.col("conv_id").alias("id"), "file_name", F.lit(1).alias("section"),
        F.col("turn").cast("bigint").alias("turn"),
        F.concat("role", F.lit(": "), "content", F.lit("\n")).alias("text"),
    )
    return rows.unionByName(talk)


def _of_account(condition: Column, by: By) -> Column:
    for i, c in enumerate(by):
        condition &= quoted(c).eqNullSafe(F.col(f"_by{i}"))
    return condition


def write_reports(rows: DataFrame, path: str, by: By = (), key: str = "seq") -> None:
    """A table of report rows in order: as many files as their size asks for, one report in few of them.

    The key is a column, so any number of reports needs no folder of its own, and the
    files' statistics find one report without reading the others.
    """
    order = [*by_columns(by), quoted(key), F.col("section"), F.col("turn")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def report_texts(rows: DataFrame, by: By = (), key: str = "seq") -> DataFrame:
    """``by, key, file_name, report``: whole texts, for reports whose conversation fits one value."""
    lines = F.array_sort(F.collect_list(F.struct("section", "turn", "text")))
    text = F.array_join(F.transform(lines, lambda r: F.concat(r["text"], F.lit("\n"))), "")
    return rows.groupBy(*by_columns(by), key, "file_name").agg(text.alias("report"))


def digest_report(digest: Column | str, as_of: Instant, model: Column | str | None = None) -> Column:
    """A digest with its banner and rulers."""
    model = F.lit(fixed.DEFAULT_MODEL) if model is None else first_truthy(model, F.lit(fixed.DEFAULT_MODEL))
    return F.concat(
        F.lit(fixed.DIGEST_HEAD), iso_text(instant(as_of)),
        F.lit("\nModel: "), model, F.lit(f"\n\n{fixed.RULER}\n\n"), as_column(digest),
        F.lit(f"\n\n{fixed.RULER}{fixed.DIGEST_FOOT}"),
    )
