"""Prompts as column expressions over the fixed texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import fixed
from ..columns import as_column
from .fields import is_truthy


def fill(template: str, **fields: Column | str) -> Column:
    """A fixed text with ``{name}`` places taken by columns."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        as_column(fields[piece]) if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces) if piece
    ])


def full_prompt(system: Column, user: Column) -> Column:
    """What the model receives: system text, blank line, user text, line end."""
    return F.concat(system, F.lit("\n\n"), user, F.lit("\n"))


def email_prompt(body: Column | str = "body") -> Column:
    return full_prompt(F.lit(fixed.EMAIL_SYSTEM), fill(fixed.EMAIL_PROMPT, body=body))


def item_prompt(kind: Column | str = "kind", title: Column | str = "title",
                content: Column | str = "content") -> Column:
    """Prompt by kind of item; NULL for a kind that is not known."""
    kind = as_column(kind)
    title = F.coalesce(as_column(title), F.lit(""))
    choice = None
    for name, template in fixed.ITEM_PROMPT.items():
        text = full_prompt(F.lit(fixed.ITEM_SYSTEM[name]), fill(template, title=title, content=content))
        choice = F.when(kind == name, text) if choice is None else choice.when(kind == name, text)
    return choice


def email_context(body: Column | str, summary: Column | str, conversation: Column | str) -> Column:
    """Mail body, then the summary if there is one, then the turns if there are any.

    ``conversation`` holds ``role: content`` lines joined by line ends.
    """
    summary, conversation = as_column(summary), as_column(conversation)
    return F.concat(
        fill(fixed.CONTEXT_MAIL, body=body),
        F.when(is_truthy(summary), fill(fixed.CONTEXT_SUMMARY, summary=summary)).otherwise(""),
        F.when(is_truthy(conversation), fill(fixed.CONTEXT_TALK, turns=conversation)).otherwise(""),
    )


def item_context(kind: Column | str, context: Column | str) -> Column:
    """The context under a heading for its kind."""
    headings = F.create_map(*[F.lit(x) for pair in fixed.CONTEXT_HEADING.items() for x in pair])
    heading = F.coalesce(headings[as_column(kind)], F.lit(fixed.CONTEXT_HEADING_DEFAULT))
    return F.concat(heading, F.lit("\n"), as_column(context))


def email_question_prompt(context: Column | str, question: Column | str) -> Column:
    user = fill(fixed.QUESTION_PROMPT, context=context, question=question)
    return full_prompt(F.lit(fixed.EMAIL_QUESTION_SYSTEM), user)


def item_question_prompt(context: Column | str, question: Column | str) -> Column:
    user = fill(fixed.QUESTION_PROMPT, context=context, question=question)
    return full_prompt(F.lit(fixed.ITEM_QUESTION_SYSTEM), user)


def digest_user_prompt() -> Column:
    """Sections of a digest row (see ``operators.digest``) as the user's request."""
    names = ("emails", "events", "reminders", "messages",
             "n_emails", "n_events", "n_reminders", "n_threads")
    return fill(fixed.DIGEST_PROMPT, **{n: F.col(n).cast("string") for n in names})


def digest_prompt() -> Column:
    return full_prompt(F.lit(fixed.DIGEST_SYSTEM), digest_user_prompt())
