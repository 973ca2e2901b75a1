import random
import re
from itertools import dropwhile

import pytest
from pyspark.sql import functions as F

from feedfold import fixed
from feedfold.functions import prompts, text


@pytest.mark.parametrize("given, clean", [
    ("", ""), ("  ", ""), ("```", ""), ("a\n```", "a"), ("a\n\n---\n ~~~ \n\n", "a"), ("a\n--", "a\n--"),
    ("a\n--- b", "a\n--- b"), ("a\n`-`-", "a\n`-`-"), ("---\na", "---\na"), ("\xa0a\xa0", "a"),
    ("a\r\nb\x0bc\u2028d", "a\nb\nc\nd"), ("a\r\n---", "a"), ("\x1ca\x1f", "a"), (None, None), ("a\n____", "a"),
    ("x" + "\n" * 5000 + "y\n" + "\n---" * 5000, "x" + "\n" * 5000 + "y"),
])
def test_clean_response(value, given, clean):
    assert value(text.clean_response("v"), v=given) == clean


@pytest.mark.parametrize("given, clean", [
    ("", ""), (None, None), ("one", "one"), ("Answer: yes", "yes"), ("FINAL ANSWER :  yes", "yes"),
    ("`a` ```b```", "a b"), ("A. B. A. C. D. E.", "A. B. C. D."), ("A.\n\nB!\tC?", "A. B! C?"),
    ("ok User Question: why", "ok"), ("x Question: q MyAnswer: z", "x"), ("x Question: q Answer: z", "x Question: q z"),
    ("A. A.", "A."), ("---\n```", ""), ("see myresponse: x", "see myresponse: x"),
])
def test_clean_chat_response(value, given, clean):
    assert value(text.clean_chat_response("v"), v=given) == clean


RULER = re.compile("(`{3,}|-{3,}|_{3,}|~{3,})?")
LABEL = re.compile(rf"\b({'|'.join(fixed.ANSWER_LABELS)})\s*:\s*", re.I)


def expected_answer(given):
    """The rules once more, in plain Python over one text."""
    backwards = dropwhile(lambda line: RULER.fullmatch(line.strip()), reversed(given.strip().splitlines()))
    base = "\n".join(list(backwards)[::-1]).strip()
    flat = " ".join(LABEL.sub("", base.replace("```", " ").replace("`", "")).split())
    head, repeated, _ = flat.partition("User Question:")
    if not repeated and "Answer:" in flat:
        head, repeated, _ = flat.partition("Question:")
    if repeated:
        return base, head.rstrip()
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", flat) if s]
    return base, " ".join(list(dict.fromkeys(sentences))[:4]) if len(sentences) > 1 else flat


def test_cleaning_random_texts(spark):
    dice = random.Random(7)
    pieces = ["Yes.", "No!", "Why?", "Answer:", "response :", "MyAnswer:", "Question:", "User Question:", "```", "`", "---",
              "~~~~", "\n", "\n\n", "\r\n", "\t", " ", "\xa0", "word", "\u2028", "\x1d", "é"]
    texts = ["".join(dice.choice(pieces) + dice.choice(["", " "]) for _ in range(dice.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", text.clean_response("t").alias("a"), text.clean_chat_response("t").alias("b")).collect()
    for row in got:
        base, short = expected_answer(texts[row.i])
        assert (row.a, row.b) == (base, short if base else ""), repr(texts[row.i])


def test_strip_code_blocks(value):
    assert value(text.strip_code_blocks("v"), v=None) is None
    assert value(text.strip_code_blocks("v"), v="") == ""
    assert value(text.strip_code_blocks("v"), v=" a ") == "a"
    assert value(text.strip_code_blocks("v"), v="a \n```x```b") == "a"


@pytest.mark.parametrize("length", [0, 1, 120, 121, 500])
def test_chunks(value, length):
    given = ("ab\n\U0001F600" * 200)[:length]
    assert value(text.chunks("v"), v=given) == [given[i:i + 120] for i in range(0, length, 120)]


@pytest.mark.parametrize("given, html", [
    ("", ""), (None, ""), ("a < b & \xa0", "<p>a &lt; b &amp; &nbsp;</p>"),
    ("**x** **y**", "<p><strong>x</strong> <strong>y</strong></p>"),
    ("### h\n## g\n# f", "<p><h4>h</h4>\n<h3>g</h3>\n# f</p>"),
    ("- a\n- b\n1. c\n", "<p><ul><li>a</li>\n<li>b</li>\n</ul>1. c\n</p>"),
    ("- a\n\n1. c", "<p><ul><li>a</li>\n</ul>\n<li>c</li></p>"),
    ("a\n\nb\n\n\n\nc", "<p>a</p><p>b</p><p>c</p>"),
    ("a\x85- b", "<p>a\x85- b</p>"), ("a\u2028- b", "<p>a\u2028<ul><li>b</li></ul></p>"),
    ("- a\n" * 20000, "<p><ul>" + "<li>a</li>\n" * 20000 + "</ul></p>"),
])
def test_markdown(value, given, html):
    assert value(text.markdown_to_html("v"), v=given) == html


def test_prompts(value):
    context = prompts.email_context("b", "s", "c")
    assert value(context, b="B", s="", c=None) == "Email Content:\nB\n\n"
    assert value(context, b="B", s="S", c="user: q") == (
        "Email Content:\nB\n\nSummary:\nS\n\nPrevious conversation:\nuser: q\n\n")
    assert value(prompts.item_context("k", "c"), k="reminder", c="C") == "Reminder context:\nC"
    assert value(prompts.item_context("k", "c"), k="else", c="C") == "Context:\nC"
    assert value(prompts.item_prompt("k", "t", "c"), k="else", t="T", c="C") is None
    prompt = value(prompts.item_prompt("k", "t", "c"), k="calendar", t=None, c="C")
    assert prompt.startswith("You are a helpful assistant that summarizes upcoming calendar events.")
    assert prompt.endswith("\n\nTitle: \nC\n\nSummary:\n")
    assert value(prompts.email_prompt("b"), b="{x}").endswith("Email:\n{x}\n\nSummary:\n")


def test_white_space_is_what_python_strips(spark):
    assert set(fixed.WHITE_SPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert spark.range(1).select(text.strip(F.lit(fixed.WHITE_SPACE))).first()[0] == ""
