"""Text generation by the caller's models, on the executors.

A model is given as ``load``: a function without arguments that returns a
function ``(prompts, budgets) -> outputs`` over lists.  It is called inside the
Python workers; only prompts that are asked and their budgets travel there (Arrow
batches), all other columns stay in the JVM.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from types import ModuleType
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..columns import as_column
from ..functions.fields import non_blank, token_budget
from ..functions.text import clean_response

Model = Callable[[list[str], list[int]], Sequence[Any]]
Loader = Callable[[], Model]
Answer = tuple[str | None, str | None]  # text, cause of a failure

CALLS = 500  # that one task makes, where there are many; prompts of one call of a model
CALL_BYTES = 4_000_000  # of them

_KEEP = 2  # loaded models of a worker


def _worker() -> ModuleType:
    """What this worker process remembers: loaded models, newest last, and why one could not be loaded.

    It is kept among the modules, because code that is sent by value comes with new globals for each task.
    """
    name = "feedfold_models_of_this_worker"
    if name not in sys.modules:
        module = ModuleType(name)
        module.loaded, module.broken = {}, {}
        sys.modules[name] = module
    return sys.modules[name]


def _named(models: Mapping[str, Loader]) -> dict[str, tuple[str, Loader]]:
    """Loaders with a name that is the same in every task: their code's hash beside the model's name."""
    return {name: (f"{name}-{hashlib.sha1(cloudpickle.dumps(load)).hexdigest()}", load) for name, load in models.items()}


def _model(name: str, load: Loader) -> Model:
    worker = _worker()
    if name in worker.broken:
        raise RuntimeError(worker.broken[name])
    if name not in worker.loaded:
        while len(worker.loaded) >= _KEEP:
            worker.loaded.pop(next(iter(worker.loaded)))
        try:
            worker.loaded[name] = load()
        except Exception as e:
            worker.broken[name] = f"{type(e).__name__}: {e}"
            raise RuntimeError(worker.broken[name]) from e
    return worker.loaded[name]


def _output_text(output: Any) -> str:
    if isinstance(output, Mapping):
        text = output.get("text") or output.get("output") or ""
        if not isinstance(text, str):
            raise TypeError(f"text of an answer is {type(text).__name__}")
        return text
    if isinstance(output, (list, tuple)) and output:
        return str(output[0])
    return str(output)


def _one(output: Any) -> Answer:
    try:
        return _output_text(output), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"


def _answer(name: str, load: Loader, prompts: list[str], budgets: list[int]) -> list[Answer]:
    """Outputs as text; a prompt the model fails on gives None and harms no other.

    A list of another length than the prompts' says nothing about which is whose: they are asked one by one.
    """
    try:
        model = _model(name, load)
    except Exception as e:
        return [(None, str(e))] * len(prompts)
    try:
        outputs = list(model(prompts, budgets))
        if len(outputs) != len(prompts):
            raise ValueError(f"{len(outputs)} answers to {len(prompts)} prompts")
        return [_one(o) for o in outputs]
    except Exception as e:
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    return [_answer(name, load, [p], [b])[0] for p, b in zip(prompts, budgets)]


def _shares(sizes: Sequence[int]) -> Iterator[slice]:
    """Consecutive prompts for one call of a model: no more than ``CALLS``, and ``CALL_BYTES`` but for one by itself."""
    start = held = 0
    for i, size in enumerate(sizes):
        if i > start and (i - start == CALLS or held + size > CALL_BYTES):
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def _caller(models: Mapping[str, Loader]):
    """An Arrow UDF (model name, prompt, budget) -> raw text and cause of a failure; no name, no call.

    Of a batch, as many rows as Spark puts in one, only the prompts of one call are Python values at a time.
    """
    known = _named(models)

    def call(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, prompts, budgets in batches:
            texts, causes = ([None] * len(prompts) for _ in "tc")
            for name, (key, load) in known.items():
                asked = pc.and_(pc.fill_null(pc.equal(names, name), False), prompts.is_valid())
                rows = pc.indices_nonzero(asked)
                sizes = pc.binary_length(prompts).take(rows).to_pylist()
                for share in _shares(sizes):
                    some = rows[share]
                    answers = _answer(key, load, prompts.take(some).to_pylist(), budgets.take(some).to_pylist())
                    for row, (text, cause) in zip(some.to_pylist(), answers):
                        texts[row], causes[row] = text, cause
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(causes, pa.string())], ["text", "cause"])

    # Not deterministic: the optimizer must neither repeat nor move the calls.
    return F.arrow_udf(call, "text string, cause string").asNondeterministic()


def _budget(prompt: Column, max_tokens: int | None) -> Column:
    return token_budget(prompt) if max_tokens is None else F.lit(max_tokens).cast("bigint")


def spread_calls(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Rows in even shares for the model calls to come: ``CALLS`` for each task, or one share for each core.

    After a selective join AQE may leave few partitions: right for a cheap step,
    wrong where each row costs seconds; and a share is what a lost task repeats.  ``rows`` is their
    number where it is known, otherwise they are counted.  ``keys`` should be unique together; without any, rows are
    dealt in turn (after a sort, so that it is repeatable).
    """
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // CALLS)), *keys)


def generate(df: DataFrame, load: Loader, max_tokens: int | None = None,
             prompt: str = "prompt", output: str = "answer", cause: str | None = None) -> DataFrame:
    """Adds the model's cleaned answer; NULL where it failed or was empty.  ``cause`` names a column for the failure."""
    one = _caller({"model": load})
    raw = one(F.lit("model"), F.col(prompt), _budget(F.col(prompt), max_tokens))
    made = df.withColumn("_raw", raw).withColumn(output, non_blank(clean_response("_raw.text")))
    return (made.withColumn(cause, F.col("_raw.cause")) if cause else made).drop("_raw")


def generate_with_fallback(df: DataFrame, models: Mapping[str, Loader], max_tokens: int | None = None,
                           prompt: str = "prompt", chosen: str | None = None,
                           output: str = "answer", cause: str | None = None) -> DataFrame:
    """Adds answer, ``model_used`` and ``error``: the chosen model first, then all
    others in order, each asked only for rows that have no answer yet.

    One narrow step per model; rows never move.  ``cause`` names a column for what the
    last model that failed on a row without answer said.
    """
    names = list(models)
    call = _caller(models)
    every = F.array(*[F.lit(n) for n in names])
    if chosen is None:
        order = every
    else:
        known = F.when(F.array_contains(every, F.col(chosen)), F.col(chosen)).otherwise(names[0])
        order = F.concat(F.array(known), F.array_remove(every, known))
    done = df.withColumn("_order", order).withColumns({
        output: F.lit(None).cast("string"), "model_used": F.lit(None).cast("string"), "_cause": F.lit(None).cast("string"),
    })
    for turn in range(len(names)):
        ask = F.when(F.col(output).isNull(), F.get("_order", F.lit(turn)))
        asked = F.when(F.col("_ask").isNotNull(), F.col(prompt))
        done = (
            done.withColumn("_ask", ask)
            .withColumn("_raw", call(F.col("_ask"), asked, _budget(asked, max_tokens)))
            .withColumn("_new", non_blank(clean_response("_raw.text")))
            .withColumn("model_used", F.when(F.col("_new").isNotNull(), F.col("_ask"))
                        .otherwise(F.col("model_used")))
            .withColumn(output, F.coalesce(output, "_new"))
            .withColumn("_cause", F.coalesce("_raw.cause", "_cause"))
            .drop("_ask", "_raw", "_new")
        )
    failed = F.when(F.col(output).isNull(), fixed.ALL_MODELS_FAILED)
    done = done.withColumn("error", failed)
    if cause:
        done = done.withColumn(cause, F.when(F.col(output).isNull(), F.col("_cause")))
    return done.drop("_order", "_cause")


def first_answer(outputs: Mapping[str, Column | str]) -> tuple[Column, Column, Column]:
    """Answer, model name and error where the models' outputs are columns already."""
    filled = {name: non_blank(as_column(column)) for name, column in outputs.items()}
    answer = F.coalesce(*filled.values())
    name = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in filled.items()])
    return answer, name, F.when(answer.isNull(), fixed.ALL_MODELS_FAILED)
