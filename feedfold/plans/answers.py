"""Answers to questions about a mail or another item."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.fields import non_blank
from ..functions.prompts import (
    email_context,
    email_question_prompt,
    item_context,
    item_question_prompt,
)
from ..functions.text import clean_chat_response
from ..operators.filters import check_requests
from ..operators.generation import Loader, generate, spread_calls


def email_question_prompts(requests: DataFrame) -> DataFrame:
    """Adds ``prompt`` to rows ``body, summary, conversation, question``."""
    context = email_context("body", "summary", "conversation")
    return requests.withColumn("prompt", email_question_prompt(context, "question"))


def item_question_prompts(requests: DataFrame) -> DataFrame:
    """Adds ``prompt`` to rows ``kind, content, question``."""
    return requests.withColumn("prompt", item_question_prompt(item_context("kind", "content"), "question"))


def _answered(asked: DataFrame, load: Loader) -> DataFrame:
    made = generate(spread_calls(asked), load, max_tokens=fixed.CHAT_TOKENS)
    return made.withColumn("answer", non_blank(clean_chat_response("answer"))).drop("prompt")


def _answer(requests: DataFrame, form: str, prompts, load: Loader, batch: bool) -> DataFrame:
    checked = check_requests(requests, form)
    made = _answered(prompts(checked.where(F.col("error").isNull())), load)
    if batch:
        made = made.withColumn("error", F.when(F.col("answer").isNull(), fixed.ERROR_ANSWER))
    bad = checked.where(F.col("error").isNotNull()).withColumn("answer", F.lit(None).cast("string"))
    return made.unionByName(bad)


def answer_email_questions(requests: DataFrame, load: Loader, batch: bool = True) -> DataFrame:
    """Adds ``answer`` and ``error``.  An empty answer is an error in the ``batch``
    form; as frames (``sources.frames.answer_frames``) it is just ``done``."""
    return _answer(requests, "email_question", email_question_prompts, load, batch)


def answer_item_questions(requests: DataFrame, load: Loader, batch: bool = True) -> DataFrame:
    return _answer(requests, "item_question", item_question_prompts, load, batch)
