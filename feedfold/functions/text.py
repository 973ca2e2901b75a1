"""Text expressions on whole texts, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from ..columns import as_column, let

FENCE_MARK = "```"
# White space inside a pattern: what (?U)\s lacks are the four separators 1c-1f.
_SPACE = r"[\s\x1c-\x1f]"
# Browsers end a line at these four characters only.
_LINE_END = r"\n\r\u2028\u2029"
_LINE = rf"[^{_LINE_END}]"
# ^ also matches after \x85, which is no line end in a browser.
_BOL = r"(?m)^(?<!\x85)"
_BROWSER_SPACE = (
    r"[\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
)


def strip(text: Column | str) -> Column:
    """Drop white space at both ends (``trim`` alone only knows the blank)."""
    return F.btrim(as_column(text), F.lit(fixed.WHITE_SPACE))


def _strip_long(text: Column) -> Column:
    """``strip`` for long texts (bound by ``let``): most need none, and looking at
    both ends costs far less than a trim, which takes stock of every character."""
    space = F.lit(fixed.WHITE_SPACE)
    ends = F.contains(space, F.substring(text, 1, 1)) | F.contains(space, F.substring(text, -1, 1))
    return F.when(ends, strip(text)).otherwise(text)


def strip_code_blocks(text: Column | str) -> Column:
    """The text before the first code fence, stripped; empty and missing stay."""
    text = as_column(text)
    return F.when(text == "", text).otherwise(strip(F.substring_index(text, FENCE_MARK, 1)))


def _is_fence(line: Column) -> Column:
    line = strip(line)
    return (line == "") | line.rlike(r"^(?:`{3,}|-{3,}|_{3,}|~{3,})$")


def _without_tail(text: Column) -> Column:
    """The text up to its last line that is neither blank nor a ruler.

    All that follows the last character rulers are not made of is short; only its
    lines are looked at one by one.
    """
    def cut(body: Column) -> Column:
        tail = F.split(F.substr(text, F.length(body) + 1), "\n")
        # The first piece ends the line that ``body`` ends in.
        own_line = body == ""
        last = F.array_max(F.transform(tail, lambda line, i: F.when(
            ((i > 0) | own_line) & _is_fence(line), 0).otherwise(i + 1)))
        return let(F.concat(body, F.array_join(F.slice(tail, F.lit(1), last), "\n")), _strip_long)

    return let(F.rtrim(text, F.lit(fixed.WHITE_SPACE + fixed.RULER_MARKS)), cut)


def _one_line_break(text: Column) -> Column:
    """Every kind of line break as a line feed."""
    return F.when(
        text.rlike(fixed.OTHER_BREAKS), F.regexp_replace(text, "\r\n|" + fixed.OTHER_BREAKS, "\n")
    ).otherwise(text)


def clean_response(text: Column | str) -> Column:
    """Strip a model's output and drop trailing blank lines and rulers.

    A single pattern with nested repetition would backtrack on long runs of blank
    lines.
    """
    return let(
        let(let(as_column(text), _strip_long), _one_line_break),
        lambda t: F.when(_is_fence(F.substring_index(t, "\n", -1)), _without_tail(t)).otherwise(t),
    )


def _flatten(text: Column) -> Column:
    """One line without code marks and answer labels."""
    labels = "|".join(fixed.ANSWER_LABELS)
    text = F.replace(F.replace(text, F.lit(FENCE_MARK), F.lit(" ")), F.lit("`"), F.lit(""))
    text = F.regexp_replace(text, rf"(?iU)\b(?:{labels}){_SPACE}*:{_SPACE}*", "")
    return let(F.regexp_replace(text, rf"(?U){_SPACE}+", " "), _strip_long)


def _shorten(text: Column) -> Column:
    """Up to a repeated question, or the first distinct sentences."""
    def before(mark: str) -> Column:
        return F.rtrim(F.substring_index(text, mark, 1))

    sentences = F.filter(F.split(text, r"(?<=[.!?]) +"), lambda s: s != "")
    brief = let(sentences, lambda found: F.when(
        F.size(found) > 1,
        F.array_join(F.slice(F.array_distinct(found), 1, fixed.ANSWER_SENTENCES), " "),
    ).otherwise(text))
    return (
        F.when(F.contains(text, F.lit("User Question:")), before("User Question:"))
        .when(F.contains(text, F.lit("Question:")) & F.contains(text, F.lit("Answer:")),
              before("Question:"))
        .otherwise(brief)
    )


def clean_chat_response(text: Column | str) -> Column:
    """``clean_response`` plus: no fences, no labels, one line, four distinct sentences."""
    return let(
        clean_response(text),
        lambda base: F.when(base == "", base).otherwise(let(_flatten(base), _shorten)),
    )


def chunks(text: Column | str, size: int = fixed.CHUNK_CHARS) -> Column:
    """Pieces of ``size`` characters in order; an empty text has none.

    One pass over the text; repeated ``substring`` would start over for each piece.
    """
    return F.regexp_extract_all(as_column(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def escape_html(text: Column | str) -> Column:
    out = F.coalesce(as_column(text), F.lit(""))
    for mark, entity in (("&", "&amp;"), ("\xa0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def markdown_to_html(text: Column | str) -> Column:
    """The small markdown subset of a digest as HTML.

    Numbered items become list items only after the bulleted runs were wrapped,
    so they never sit in a list of their own.
    """
    html = escape_html(text)
    html = F.regexp_replace(html, rf"\*\*({_LINE}+?)\*\*", "<strong>$1</strong>")
    html = F.regexp_replace(html, rf"{_BOL}### ({_LINE}+)", "<h4>$1</h4>")
    html = F.regexp_replace(html, rf"{_BOL}## ({_LINE}+)", "<h3>$1</h3>")
    html = F.regexp_replace(html, rf"{_BOL}- ({_LINE}+)", "<li>$1</li>")
    html = F.regexp_replace(html, rf"((?:<li>{_LINE}*</li>\n?)++)", "<ul>$1</ul>")
    html = F.regexp_replace(html, rf"{_BOL}[0-9]+\. ({_LINE}+)", "<li>$1</li>")
    html = F.replace(html, F.lit("\n\n"), F.lit("</p><p>"))
    html = F.concat(F.lit("<p>"), html, F.lit("</p>"))
    return F.regexp_replace(html, rf"<p>{_BROWSER_SPACE}*</p>", "")
