"""Chat formatting from every participant's side: the speaker becomes the assistant, the others named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"  # fixed values of the format
SPAN = 1_024  # turns whose lengths are summed up together


def _escaped(text: Column) -> Column:
    """Text that would be read as a mark is set apart from it."""
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("<|", "< |")))
    return text


def perspectives(turns: DataFrame, system_roles: tuple[str, ...] = ("system",), conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each participant of a conversation and turn: conv_id, perspective, turn, role, rendered,
    start_char, end_char, mask_start, mask_end.

    Participants are the roles that speak and are none of ``system_roles``.  In a participant's dialogue its own turns are
    the assistant's, turns of ``system_roles`` stay the system's, all others are a named user's. start_char and end_char
    are where the rendered turn is in the whole dialogue (in characters); mask_start and mask_end are where that is
    learned: an own turn's text and end mark, otherwise null. ``rendered`` in order of start_char is the dialogue.

    Turns are in order of number, role and text, nulls last. A null role is a user without name and no participant; a null
    text is empty; a null conversation is one of its own; marks in texts and roles are escaped, line breaks of a role become spaces. Repeated turns are said twice.
    A conversation without participants and an empty table give no rows. Other columns are ignored.
    Lengths are summed over spans of turn numbers first and then within each span, so that a very long conversation
    is spread over many tasks; only turns with nearly equal numbers need one another.
    """
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = said.select("conv_id", "role").where(F.col("role").isNotNull() & ~F.col("role").isin(*system_roles)).distinct()
    who = known.select(F.col("conv_id").alias("of"), F.col("role").alias("perspective"))
    rows = said.join(who, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    line = F.translate(_escaped(F.col("role")), "\n\r", "  ")  # a role must not end its header line
    named = F.when(F.col("role").isNull(), "user").otherwise(F.concat(F.lit("user name="), line))
    speaker = F.when(own, "assistant").when(F.col("role").isin(*system_roles), line).otherwise(named)
    head = F.concat(F.lit(START), speaker, F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", F.concat(_escaped(F.col("text")), F.lit(END))).withColumn(
        "n", F.char_length("head") + F.char_length("body") + 1).withColumn("span", F.floor(F.col("turn") / SPAN)).withColumn(
        "own", own)
    order = [F.col(c).asc_nulls_last() for c in ("turn", "role", "text")]
    inside = Window.partitionBy("conv_id", "perspective", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    spans = rows.groupBy("conv_id", "perspective", "span").agg(F.sum("n").alias("all"))
    ahead = Window.partitionBy("conv_id", "perspective").orderBy(F.col("span").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    spans = spans.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("span").alias("s"),
                         F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"))
    rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p"))
                     & F.col("span").eqNullSafe(F.col("s")))
    start = F.col("ahead") + F.col("before")
    return rows.select("conv_id", "perspective", "turn", "role", F.concat("head", "body", F.lit("\n")).alias("rendered"),
                       start.alias("start_char"), (start + F.col("n")).alias("end_char"),
                       F.when(F.col("own"), start + F.char_length("head")).alias("mask_start"),
                       F.when(F.col("own"), start + F.col("n") - 1).alias("mask_end"))


SQL = r"""
with said as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
), who as (
  select distinct conv_id, role as perspective from said where role is not null and role <> 'system'
), parts as (
  select said.*, perspective, coalesce(role = perspective, false) as own,
    '<|im_start|>' || case when role = perspective then 'assistant' when role = 'system' then role
      when role is null then 'user'
      else 'user name=' || translate(replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>'), chr(10) || chr(13), '  ')
      end || chr(10) as head,
    replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' as body
  from said join who on said.conv_id is not distinct from who.conv_id
), placed as (
  select *, length(head) + length(body) + 1 as n,
    coalesce(sum(length(head) + length(body) + 1) over (partition by conv_id, perspective
      order by turn nulls last, role nulls last, text rows between unbounded preceding and 1 preceding), 0)::bigint as start_char
  from parts
)
select conv_id, perspective, turn, role, head || body || chr(10) as rendered, start_char, start_char + n as end_char,
  case when own then start_char + length(head) end as mask_start, case when own then start_char + n - 1 end as mask_end
from placed"""
