"""Results as ordered JSON frames, one row per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..columns import quoted
from ..functions.fields import is_truthy
from ..functions.text import chunks

_FRAME = "struct<type:string,content:string,value:boolean,phase:string,message:string>"


def _frame(kind: str, content: Column | None = None, value: bool | None = None,
           phase: str | None = None, message: str | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        (F.lit(None) if content is None else content).cast("string").alias("content"),
        F.lit(value).cast("boolean").alias("value"),
        F.lit(phase).cast("string").alias("phase"),
        F.lit(message).cast("string").alias("message"),
    )


def _text_frames(text: Column) -> Column:
    return F.transform(chunks(text), lambda piece: _frame("chunk", piece))


def _rows(df: DataFrame, frames: Column, keys: list[str]) -> DataFrame:
    exploded = df.select(*[quoted(k) for k in keys], F.posexplode(frames).alias("frame_no", "_frame"))
    # Unset fields are left out of the JSON.
    return exploded.select(
        *[quoted(k) for k in keys], F.col("frame_no").cast("int").alias("frame_no"),
        F.to_json("_frame").alias("frame"),
    )


def summary_frames(results: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of summaries (``summary, model_used, cached, error``).

    A stored summary is one chunk, then ``cached``; a new one is cut into chunks,
    then names its model; both end with ``done``.  A failure is one ``error``.
    """
    done = F.array(_frame("done"))
    cached = F.concat(
        F.array(_frame("chunk", F.col("summary"))), F.array(_frame("cached", value=True)), done
    )
    fresh = F.concat(
        _text_frames(F.coalesce("summary", F.lit(""))), F.array(_frame("model", F.col("model_used"))), done
    )
    frames = (
        F.when(F.col("error").isNotNull(), F.array(_frame("error", F.col("error"))))
        .when(F.col("cached"), cached).otherwise(fresh)
    )
    return _rows(results, frames, keys)


def answer_frames(results: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Frames of chat answers: the chunks and ``done``; an empty answer is ``done`` alone."""
    text = F.when(is_truthy(answer), F.col(answer)).otherwise("")
    frames = F.concat(_text_frames(text), F.array(_frame("done")))
    if "error" in results.columns:
        frames = F.when(
            F.col("error").isNotNull(), F.array(_frame("error", F.col("error")))
        ).otherwise(frames)
    return _rows(results, frames, keys)


def digest_frames(digests: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Frames of digests: three progress frames, then the text like a new summary."""
    phases = F.array(*[_frame("status", phase=p, message=m) for p, m in fixed.DIGEST_PHASES])
    good = F.concat(
        _text_frames(F.coalesce(answer, F.lit(""))),
        F.array(_frame("model", F.col("model_used"))), F.array(_frame("done")),
    )
    rest = F.when(
        F.col("error").isNotNull(), F.array(_frame("error", F.col("error")))
    ).otherwise(good)
    return _rows(digests, F.concat(phases, rest), keys)


def write_frames(frames: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines, frames of one result next to each other and in order.

    The range split is on (keys, frame number), so even one very long result is
    written by several tasks.
    """
    order = [*[quoted(k) for k in keys], F.col("frame_no")]
    ordered = frames.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.to_json(F.struct(*[quoted(k) for k in keys], "frame_no", "frame"))).write.text(path)
