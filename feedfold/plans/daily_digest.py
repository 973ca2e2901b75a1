"""The daily digest: four feeds, one prompt per account."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..columns import By, Instant
from ..functions.prompts import digest_prompt
from ..operators import digest as ops
from ..operators.filters import due_window, look_ahead, look_back, open_only
from ..operators.generation import Loader, generate_with_fallback, spread_calls
from ..operators.threads import digest_threads
from .message_threads import recent_messages


def digest_blocks(emails: DataFrame, calendar: DataFrame, reminders: DataFrame,
                  messages: DataFrame, as_of: Instant, by: By = ()) -> dict[str, DataFrame]:
    """The four blocks over the last 24 hours of mail and messages and today's dates."""
    newest = recent_messages(messages, as_of, 24, fixed.DIGEST_MESSAGE_FETCH, by)
    return {
        "emails": ops.email_block(look_back(emails, as_of, 24), by),
        "events": ops.event_block(look_ahead(calendar, as_of, 1), by),
        "reminders": ops.reminder_block(due_window(open_only(reminders), as_of, 1), by),
        "messages": ops.message_block(digest_threads(newest, None, by), by),
    }


def daily_digest(emails: DataFrame, calendar: DataFrame, reminders: DataFrame,
                 messages: DataFrame, as_of: Instant, by: By = ()) -> DataFrame:
    """One row per account: blocks, counts and the prompt."""
    blocks = digest_blocks(emails, calendar, reminders, messages, as_of, by)
    return ops.digest_join(blocks, by).withColumn("prompt", digest_prompt())


def write_digests(digests: DataFrame, models: Mapping[str, Loader],
                  chosen: str | None = None) -> DataFrame:
    """Adds ``answer``, ``model_used`` and ``error`` to digest rows."""
    return generate_with_fallback(spread_calls(digests), models, chosen=chosen)


def count_row(blocks: Mapping[str, DataFrame]) -> DataFrame:
    return ops.digest_join(blocks).select(*[F.col(c) for c in ops.COUNTS.values()])
