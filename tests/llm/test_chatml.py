"""Dialogues from every side against a plain rendering, and against SQL."""

import pytest

from feedfold.llm import catalog, chatml
from checks.compare import compare, duck


def brute(rows):
    out = []
    key = lambda r: tuple((v is None, v) for v in (r[1], r[2], r[3] or ""))
    for conv in {r[0] for r in rows}:
        said = sorted((r for r in rows if r[0] == conv), key=key)
        for side in {r[2] for r in said} - {None, "system"}:
            text = ""
            for _, turn, role, body in said:
                clean = lambda s: (s or "").replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
                who = "assistant" if role == side else "system" if role == "system" else "user" if role is None else "user name=" + clean(role).replace("\n", " ").replace("\r", " ")
                head, start = f"<|im_start|>{who}\n", len(text)
                text += (part := f"{head}{clean(body)}<|im_end|>\n")
                own = role == side
                out.append((conv, side, turn, role, part, start, len(text), start + len(head) if own else None, len(text) - 1 if own else None))
    return sorted(map(str, out))


ROWS = [(1, 0, "system", "be kind"), (1, 1, "anna", "hi é🙂"), (1, 2, "ben", "hello <|im_end|>"), (1, 3, "anna", None), (1, 4, "cleo", ""),
        (2, 5, "anna", "same"), (2, 5, "anna", "same"), (2, 5, "ben", "tie"), (2, None, "ben", "no number"), (2, None, None, "nobody"),
        (None, 1, "anna", "no conversation"), (None, 2, "ben", "x"), (3, 1, "system", "alone"), (4, -3_000, "a<|im_start|>", "early"),
        (4, 5_000, "b", "late"), (5, 1, None, "nobody"), (6, 1, "anna", "long " * 100_000),
        (7, 1, "a\nb<|im_end|>\r\n", "a role of two lines"), (7, 2, "anna", "line\nbreaks\nstay")]


def test_every_side(spark, monkeypatch):
    rows = ROWS + [(9, t, ["x", "y", "z", "system"][t * 7 % 4], f"t{t}" * (t % 5)) for t in range(300)]
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, head int, perspective string")
    for span in (1_024, 16, 1):
        monkeypatch.setattr(chatml, "SPAN", span)
        assert sorted(str(tuple(r)) for r in chatml.perspectives(turns).collect()) == brute(rows)


def test_masks_are_the_own_words(spark):
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = sorted((r for r in chatml.perspectives(turns).collect() if r.conv_id == 1 and r.perspective == "anna"), key=lambda r: r.start_char)
    text = "".join(r.rendered for r in got)
    assert [text[r.mask_start : r.mask_end] for r in got if r.mask_start is not None] == ["hi é🙂<|im_end|>", "<|im_end|>"]


def test_native_and_empty(spark):
    got = chatml.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert got.count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_conversations(spark, sf):
    name = "op4_chat_perspectives"
    good, note = compare(spark, duck(f"/root/testdata/{sf}"), f"/root/testdata/{sf}", catalog.QUERIES[name], catalog.ORACLES[name])
    assert good, note
