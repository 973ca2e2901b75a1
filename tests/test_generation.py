import sys

import pytest
from pyspark import cloudpickle

from feedfold.operators import generation
from feedfold.plans import answers, summarize
from feedfold.sources.store import SummaryStore

NOW = 1706659200
# The workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def echo():
    return lambda prompts, budgets: [f" {p}:{b}\n---" for p, b in zip(prompts, budgets)]


def shapes():
    kinds = {"dict": {"text": "t"}, "other": {"text": "", "output": "o"}, "bare": {"x": 1}, "list": ["l", "m"],
             "tuple": ("u",), "none": None, "number": 7, "nothing": "", "empty": []}
    return lambda prompts, budgets: [kinds[p] for p in prompts]


def picky():
    def call(prompts, budgets):
        if any(p == "bad" for p in prompts):
            raise ValueError("no")
        return ["fine"] * len(prompts)
    return call


def silent():
    return lambda prompts, budgets: ["```"] * len(prompts)


def short():
    return lambda prompts, budgets: ["S"] * len(prompts)


def missing():
    raise RuntimeError("not there")


def answered(df):
    return {r.prompt: r.answer for r in df.collect()}


def test_budget_and_cleaning(rows):
    df = rows("prompt string", ("p",), ("x" * 2000,), (None,))
    got = answered(generation.generate(df, echo))
    assert got == {"p": "p:128", "x" * 2000: "x" * 2000 + ":250", None: None}
    assert answered(generation.generate(df, echo, max_tokens=160))["p"] == "p:160"


def test_output_shapes(rows):
    names = ["dict", "other", "bare", "list", "tuple", "none", "number", "nothing", "empty"]
    got = answered(generation.generate(rows("prompt string", *[(n,) for n in names]), shapes))
    assert got == {"dict": "t", "other": "o", "bare": None, "list": "l", "tuple": "u", "none": "None",
                   "number": "7", "nothing": None, "empty": "[]"}


def test_a_failing_prompt_fails_alone(rows):
    df = rows("prompt string", ("a",), ("bad",), ("c",)).coalesce(1)
    assert answered(generation.generate(df, picky)) == {"a": "fine", "bad": None, "c": "fine"}
    assert answered(generation.generate(df, missing)) == {"a": None, "bad": None, "c": None}


def test_fallback_order(rows):
    df = rows("prompt string, model string", ("a", "short"), ("b", "silent"), ("bad", "picky"), ("d", "gone"), ("e", None))
    models = {"silent": silent, "picky": picky, "short": short}
    got = {r.prompt: (r.answer, r.model_used, r.error) for r in generation.generate_with_fallback(df, models, chosen="model").collect()}
    assert got == {"a": ("S", "short", None), "b": ("fine", "picky", None), "bad": ("S", "short", None),
                   "d": ("fine", "picky", None), "e": ("fine", "picky", None)}
    failed = generation.generate_with_fallback(df, {"silent": silent, "missing": missing}).first()
    assert (failed.answer, failed.model_used, failed.error) == (None, None, "All models failed")


def test_prompts_alone_travel_to_python(rows):
    df = rows("prompt string, body string", ("a", "b"))
    plan = generation.generate(df, echo)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan


def one_short():
    return lambda prompts, budgets: [f"to {p}" for p in prompts][: max(1, len(prompts) - 1)]


def not_text():
    return lambda prompts, budgets: [{"text": 5} if p == "bad" else {"text": "ok"} for p in prompts]


def test_answers_of_another_number_are_asked_for_one_by_one(rows):
    df = rows("prompt string", ("a",), ("b",), ("c",)).coalesce(1)
    assert answered(generation.generate(df, one_short)) == {"a": "to a", "b": "to b", "c": "to c"}
    def none_at_all():
        return lambda prompts, budgets: []
    assert set(answered(generation.generate(df, none_at_all)).values()) == {None}


def test_a_record_without_text_fails_alone(rows):
    df = rows("prompt string", ("a",), ("bad",), ("c",)).coalesce(1)
    got = {r.prompt: (r.answer, r.why) for r in generation.generate(df, not_text, cause="why").collect()}
    assert got == {"a": ("ok", None), "bad": (None, "TypeError: text of an answer is int"), "c": ("ok", None)}


def marked(folder, fails=False):
    """A model that leaves a mark for each time it is loaded, with the worker's number."""
    def load():
        import os
        import uuid
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        if fails:
            raise OSError("no weights")
        return lambda prompts, budgets: ["x"] * len(prompts)
    return load


@pytest.mark.parametrize("fails", [False, True])
def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path, fails):
    df = spark.range(400).selectExpr("cast(id as string) as prompt").repartition(200)
    made = generation.generate_with_fallback(df, {"m": marked(str(tmp_path), fails)}, cause="why")
    assert {(r.answer, r.why) for r in made.collect()} == {(None, "OSError: no weights") if fails else ("x", None)}
    workers = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert 1 <= len(workers) == len(set(workers)) < 200  # earlier tests have left idle workers, which take turns


def test_answered_rows_are_not_sent_again(rows):
    def counting():
        def call(prompts, budgets):
            assert all(p == "bad" for p in prompts)
            return ["late"] * len(prompts)
        return call
    df = rows("prompt string", ("a",), ("bad",)).coalesce(1)
    got = generation.generate_with_fallback(df, {"one": picky, "two": counting})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.prompt: r.model_used for r in got.collect()} == {"a": "one", "bad": "two"}
    assert "CASE WHEN isnotnull(_ask" in plan


def test_calls_are_spread_by_rows(spark):
    many = spark.range(20_000)
    assert generation.spread_calls(many).rdd.getNumPartitions() == 40
    assert generation.spread_calls(many, "id", rows=10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


REQUEST = "seq bigint, email_id string, subject string, sender string, email_date string, body string"


def counted(folder):
    """A model that leaves a mark for each prompt it is asked."""
    def load():
        import os
        import uuid

        def call(prompts, budgets):
            for _ in prompts:
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return ["" if "EMPTY" in p else "made" for p in prompts]
        return call
    return load


def test_summaries_are_made_once_and_stored(spark, rows, tmp_path):
    import os
    marks = tmp_path / "marks"
    marks.mkdir()
    store = SummaryStore(spark, str(tmp_path / "store"))
    models = {"m": counted(str(marks))}
    requests = rows(REQUEST, (1, "a", "s", "f", "d", "text"), (2, "a", "s", "f", "d", "text"), (3, None, "s", "f", "d", "text"),
                    (4, None, "s", "f", "d", "text"), (5, "e", "s", "f", "d", ""), (6, "x", "s", "f", "d", "EMPTY"), (7, "x", "s", "f", "d", "EMPTY"))
    out = summarize.summarize_emails(requests, store, models, NOW, tag="b0")
    got = {r.seq: (r.summary, r.model_used, r.cached, r.error) for r in out.collect()}
    fail = (None, None, False, "All models failed")
    assert got == {1: ("made", "m", False, None), 2: ("made", None, True, None), 3: ("made", "m", False, None),
                   4: ("made", "m", False, None), 5: (None, None, False, "No email body provided"), 6: fail, 7: fail}
    assert len(os.listdir(marks)) == 4
    assert sorted((r.id, r.email_id or "") for r in store.read().collect()) == [(1, "a"), (2, ""), (3, "")]  # ids have no gaps, whatever seq has

    again = summarize.summarize_emails(requests.where("seq < 3"), store, models, NOW, tag="b0").collect()
    assert {(r.summary, r.cached) for r in again} == {("made", True)}
    assert len(os.listdir(marks)) == 4 and store.read().count() == 3


def test_item_summaries_lose_code_blocks(rows):
    def fenced():
        return lambda prompts, budgets: ["```only code```" if "CODE" in p else "text ```x``` more" for p in prompts]
    df = rows("kind string, title string, content string", ("calendar", None, "c"), ("reminder", "t", "CODE"), ("other", "t", "c"))
    got = {r.kind: (r.summary, r.error) for r in summarize.summarize_items(df, {"m": fenced}).collect()}
    assert got == {"calendar": ("text", None), "reminder": (None, "Failed to generate summary"), "other": (None, "Unknown kind: other")}


@pytest.mark.parametrize("batch, error", [(True, "Failed to generate response"), (False, None)])
def test_empty_answers(rows, batch, error):
    df = rows("kind string, content string, question string", ("calendar", "c", "q"))
    row = answers.answer_item_questions(df, silent, batch=batch).first()
    assert (row.answer, row.error) == (None, error)


def test_email_answers(rows):
    df = rows("body string, summary string, conversation string, question string", ("b", "s", "User: q", "q"), ("b", None, None, ""))
    def labelled():
        return lambda prompts, budgets: [f"Answer: {b} tokens. Yes. Yes." for b in budgets]
    got = {r.question: (r.answer, r.error) for r in answers.answer_email_questions(df, labelled).collect()}
    assert got == {"q": ("160 tokens. Yes.", None), "": (None, "Question and email body are required")}


def test_prompts_are_values_for_one_call_at_a_time(spark):
    """A batch of Spark's, 10,000 rows of any length, was one list of prompts."""
    def counts():
        return lambda prompts, budgets: [f"{len(prompts)} {sum(map(len, prompts))} {type(budgets[0]).__name__}" for _ in prompts]

    df = spark.range(0, 1_300, 1, 1).selectExpr("if(id % 13 = 0, null, repeat('x', if(id < 10, 1500000, 3))) as prompt")
    made = generation.generate_with_fallback(df, {"m": counts}).where("prompt is not null").collect()
    got = [tuple(r.answer.split()) for r in made]
    assert len(got) == 1_200 and {kind for _, _, kind in got} == {"int"}
    assert max(int(n) for n, _, _ in got) == generation.CALLS and max(int(size) for _, size, _ in got) <= generation.CALL_BYTES
    assert [s.stop - s.start for s in generation._shares([3, 9_000_000, 2_000_000, 2_000_000, 1, *[0] * 600])] == [1, 1, 2, 500, 101]
    assert list(generation._shares([])) == []
