"""Threads of a rolling window, exact to the second, as a stream of changes.

A message is in the window from its second until ``window`` later.  Threads are dealt to cells; a cell is a key of a stateful operator
that holds its threads' messages by hour and a roll-up of each hour; timers in event time say when the next message comes due or leaves.
Once the watermark has passed a second, what the thread is from then on leaves as a row.  A batch opens only the hours whose
messages come or go; of the others the roll-up is enough.  What a batch costs follows from cells and messages, not from threads: a cell's
changes are worked out together, as arrays.
"""

from __future__ import annotations

import marshal
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..columns import By, Instant, by_columns, instant
from ..functions.fields import thread_key, thread_title

HOUR = 3600
SHARES = 16
CELLS = 64
ROWS = 50_000  # of changes that leave as one frame
NO_SEQ = 2**63 - 1  # stands for a missing number, and is the last as such


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where the first least of ``values[low:high]`` is, for many ranges at once; no range is empty."""
    out = np.empty(len(low), np.int64)
    levels = np.frexp(high - low)[1] - 1  # a range is two, perhaps overlapping, of 2 ** level places
    at = np.arange(len(values))  # of the least among 2 ** level places from each on
    for level in range(levels.max(initial=-1) + 1):
        which, width = np.flatnonzero(levels == level), 1 << level
        one, two = at[low[which]], at[high[which] - width]
        out[which] = np.where(values[two] < values[one], two, one)
        one, two = at[:-width], at[width:]
        at = np.where(values[two] < values[one], two, one)
    return out


class RollingThreads(StatefulProcessor):
    """State of a cell, which has shares of any number of threads.

    ``view`` (one small value): the second up to which all is settled; the first second of each hour with waiting messages, and of each
    in the window; the next timer.  ``waiting`` and ``window``: messages by hour that the watermark has not passed, and that are in the
    window (without texts).  ``rolled``: of an hour in the window, each share's count, first and latest message.
    """

    def __init__(self, seconds: int, keys: list[str]):
        self.seconds, self.keys = seconds, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        value, hour = StructType([StructField("value", BinaryType())]), StructType([StructField("hour", LongType())])
        self.handle = handle
        self.view = handle.getValueState("view", value)
        self.waiting = handle.getMapState("waiting", hour, value)
        self.window = handle.getMapState("window", hour, value)
        self.rolled = handle.getMapState("rolled", hour, value)
        own = [(k, pa.int32() if k == "share" else pa.large_string()) for k in self.keys]
        self.items = pa.schema([*own, ("second", pa.int64()), ("seq", pa.int64()), ("text", pa.large_string()),
                                ("n", pa.int64()), ("first", pa.int64()), ("title", pa.large_string())])
        self.messages = pa.schema([f for f in self.items if f.name not in ("n", "first")])

    def _view(self) -> dict:
        return marshal.loads(bytes(self.view.get()[0])) if self.view.exists() else {"settled": None, "waiting": {}, "hours": {}, "timer": None}

    def _load(self, state, hour: int) -> pa.Table:
        return pa.ipc.open_stream(bytes(state.getValue((hour,))[0])).read_all()

    def _save(self, state, hour: int, table: pa.Table) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.combine_chunks())
        state.updateValue((hour,), (sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        view = self._view()
        new = pa.concat_tables([pa.Table.from_pandas(part[self.messages.names], self.messages, preserve_index=False) for part in rows])
        for hour, messages in self._by_hour(new):
            first = pc.min(messages["second"]).as_py()
            if hour in view["waiting"]:
                messages = pa.concat_tables([self._load(self.waiting, hour), messages])
            self._save(self.waiting, hour, messages)
            view["waiting"][hour] = min(first, view["waiting"].get(hour, first))
        self._keep(view)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.view.exists():
            return
        view = self._view()
        if view["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            view["timer"] = None
        # A second is settled when the watermark is at its end.
        until = timerValues.getCurrentWatermarkInMs() // 1000 - 1
        changes = self._settle(view, until)
        view["settled"] = until
        self._keep(view)
        yield from changes

    @staticmethod
    def _by_hour(messages: pa.Table) -> list[tuple[int, pa.Table]]:
        hours = messages["second"].to_numpy() // HOUR
        order = np.argsort(hours, kind="stable")
        messages, hours = messages.take(order), hours[order]
        starts = np.flatnonzero(np.diff(hours, prepend=hours[:1] - 1))
        return [(int(hours[i]), messages.slice(i, j - i)) for i, j in zip(starts, [*starts[1:], len(hours)])]

    def _singles(self, messages: pa.Table) -> pa.Table:
        """Messages as items that count one and are their own first."""
        if "text" not in messages.column_names:
            messages = messages.append_column("text", pa.nulls(len(messages), pa.large_string()))
        return messages.append_column("n", pa.array(np.ones(len(messages), np.int64))).append_column(
            "first", messages["seq"]).select(self.items.names)

    def _due(self, view: dict, until: int) -> pa.Table:
        """Waiting messages up to a second, which wait no longer."""
        due = [self.messages.empty_table()]
        for hour in [h for h, first in view["waiting"].items() if first <= until]:
            messages = self._load(self.waiting, hour)
            passed = pc.less_equal(messages["second"], until)
            due.append(messages.filter(passed))
            later = messages.filter(pc.invert(passed))
            if len(later):
                self._save(self.waiting, hour, later)
                view["waiting"][hour] = pc.min(later["second"]).as_py()
            else:
                self.waiting.removeKey((hour,))
                del view["waiting"][hour]
        return pa.concat_tables(due)

    def _settle(self, view: dict, until: int) -> Iterator[pd.DataFrame]:
        """The shares after each second at which messages came or went, up to ``until``."""
        gone = until - self.seconds  # what was sent up to then has left
        arrivals = self._due(view, until)
        opened = [h for h, first in view["hours"].items() if first <= gone]
        parts = []
        for hour in opened:
            messages = self._load(self.window, hour)
            parts.append(self._singles(messages.filter(pc.greater(messages["second"], view["settled"] - self.seconds))))
        for hour in view["hours"]:
            rolled = self._load(self.rolled, hour)
            if hour in opened:  # its messages count themselves; the roll-up stays at the place of the latest one, as it has the text
                none = pa.array(np.zeros(len(rolled), np.int64))
                rolled = rolled.set_column(rolled.column_names.index("n"), "n", none).set_column(
                    rolled.column_names.index("first"), "first", pa.array(np.full(len(rolled), NO_SEQ)))
            parts.append(rolled)
        items = pa.concat_tables([*parts, self._singles(arrivals)]).combine_chunks()
        if not len(items):
            return iter([])
        ids = np.zeros(len(items), np.int64)
        for name in self.keys:
            codes = pc.dictionary_encode(items[name].combine_chunks(), null_encoding="encode").indices.to_numpy().astype(np.int64)
            ids = np.unique(ids * (codes.max() + 1) + codes, return_inverse=True)[1]
        came = np.arange(len(items)) >= len(items) - len(arrivals)
        # Stable: a roll-up comes after its latest message.
        order = np.lexsort((items["seq"].to_numpy(), items["second"].to_numpy(), ids))
        items, ids, came = items.take(order), ids[order], came[order]
        second, n, first = (items[c].to_numpy() for c in ("second", "n", "first"))

        # Places of shares and seconds in one order.
        start = second.min() - self.seconds
        span = until - start + 1
        place = ids * span + (second - start)
        leaves = second <= gone
        moments = np.unique(np.concatenate([place[came], place[leaves] + self.seconds]))
        low, high = np.searchsorted(place, moments - self.seconds, "right"), np.searchsorted(place, moments, "right")
        of = np.searchsorted(ids, moments // span)  # the share's first item
        low = np.maximum(low, of)
        counts = np.concatenate([[0], np.cumsum(n)])
        counts = counts[high] - counts[low]
        left = counts == 0
        firsts = np.zeros(len(moments), np.int64)
        firsts[~left] = _least(first, low[~left], high[~left])
        seconds = moments % span + start

        self._roll(view, items, ids, second, n, first, came, opened, gone)
        return self._frames(items, seconds, counts, of, firsts, high - 1, left)

    def _roll(self, view: dict, items: pa.Table, ids, second, n, first, came, opened: list[int], gone: int) -> None:
        """Store what stays in the window of the hours whose messages came or went."""
        hours = second // HOUR
        stays = second > gone
        changed = np.union1d(opened, hours[came & stays]).astype(np.int64)
        kept = items.filter(pa.array(stays & came)).drop_columns(["text", "n", "first"])
        for hour, messages in self._by_hour(kept):
            if hour in view["hours"]:
                messages = pa.concat_tables([self._load(self.window, hour), messages])
            self._save(self.window, hour, messages)
        for hour in changed.tolist():
            at = np.flatnonzero(stays & (hours == hour))
            if not len(at):
                self.window.removeKey((hour,))
                self.rolled.removeKey((hour,))
                del view["hours"][hour]
                continue
            starts = np.flatnonzero(np.diff(ids[at], prepend=-1))
            ends = np.append(starts[1:], len(at))
            latest, least = at[ends - 1], at[_least(first[at], starts, ends)]
            rolled = items.take(latest)
            for name, column in (("n", pa.array(np.add.reduceat(n[at], starts))), ("first", pa.array(first[least])), ("title", items["title"].take(least))):
                rolled = rolled.set_column(rolled.column_names.index(name), name, column)
            self._save(self.rolled, hour, rolled)
            # A roll-up stands at its latest message, so it does not tell the first second of an hour that was not opened.
            earliest = int(second[at].min())
            view["hours"][hour] = earliest if hour in opened else min(earliest, view["hours"].get(hour, earliest))

    def _frames(self, items: pa.Table, seconds, counts, of, firsts, latest, left) -> Iterator[pd.DataFrame]:
        for i in range(0, len(seconds), ROWS):
            part = slice(i, i + ROWS)
            none = left[part]
            first, last = pa.array(firsts[part], mask=none), pa.array(latest[part], mask=none)
            taken = lambda name, at: items[name].take(at)
            number = lambda name, at: taken(name, at).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            yield pd.DataFrame({
                **{k: taken(k, of[part]).to_pandas() for k in self.keys}, "moment": seconds[part], "message_count": counts[part],
                "first_seq": number("first", first), "title": taken("title", first).to_pandas(), "last_ts": number("second", last),
                "last_seq": number("seq", last), "last_message": taken("text", last).to_pandas()})

    def _keep(self, view: dict) -> None:
        """Store the view, and see to a timer for the next second at which something comes or goes."""
        following = [*view["waiting"].values(), *(first + self.seconds for first in view["hours"].values())]
        if not following:
            self.view.clear()
            return
        timer = (min(following) + 1) * 1000
        if view["timer"] is None or timer < view["timer"]:
            if view["timer"] is not None:
                self.handle.deleteTimer(view["timer"])
            self.handle.registerTimer(timer)
            view["timer"] = timer
        self.view.update((marshal.dumps(view),))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """The RocksDB state store, which queries that are started within need; afterwards the session is as before."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def stream_live_threads(messages: DataFrame, ts: str = "ts", delay: str = "1 hour", window_hours: int = 48, by: By = (),
                        shares: int = SHARES, cells: int = CELLS) -> DataFrame:
    """``by, thread_id, share, moment, message_count, first_seq, title, last_ts, last_seq, last_message``: what a share of a
    thread is from a second (``moment``) on, in append mode, for ``threads_at``.

    ``timestamp`` holds the whole seconds of ``ts``; rows without a time are left out, later ones than ``delay`` too.
    A thread is dealt to ``shares`` by ``seq``, so that one with a third of all messages is in many tasks; shares are dealt to ``cells``
    by hash, whose number has to stay while the stream's state is used (a cell's messages of an hour are one value).  Columns ``by`` are
    of types that a cast to text and back keeps.  The query has to be started with the RocksDB state store (``state_store``).
    """
    if window_hours < 2:
        raise ValueError("the window has to be two hours or longer")
    accounts = [c.cast("string").alias(f"by{i}") for i, c in enumerate(by_columns(by))]
    keyed = messages.withWatermark(ts, delay).where(F.col("timestamp").isNotNull() & F.col(ts).isNotNull()).select(
        *accounts, thread_key().alias("thread_id"), F.pmod(F.xxhash64("seq"), F.lit(shares)).cast("int").alias("share"),
        F.col(ts), F.col("timestamp").cast("bigint").alias("second"), F.coalesce(F.col("seq").cast("bigint"), F.lit(NO_SEQ)).alias("seq"),
        thread_title().cast("string").alias("title"), F.col("text").cast("string").alias("text"))
    keys = [*(f"by{i}" for i in range(len(accounts))), "thread_id", "share"]
    keyed = keyed.withColumn("cell", F.pmod(F.xxhash64(*keys), F.lit(cells)).cast("int"))
    out = StructType([StructField(k, IntegerType() if k == "share" else StringType()) for k in keys]
                     + [StructField(c, LongType()) for c in ("moment", "message_count", "first_seq")]
                     + [StructField("title", StringType()), StructField("last_ts", LongType()), StructField("last_seq", LongType()),
                        StructField("last_message", StringType())])
    changes = keyed.groupBy("cell").transformWithStateInPandas(
        RollingThreads(window_hours * HOUR, keys), outputStructType=out, outputMode="Append", timeMode="EventTime")
    types = [messages.select(c).schema[0].dataType for c in by_columns(by)]
    known = lambda c: F.nullif(F.col(c), F.lit(NO_SEQ)).alias(c)
    return changes.select(
        *[F.col(f"by{i}").cast(kind).alias(c) for i, (c, kind) in enumerate(zip(by, types))], "thread_id", "share", "moment", "message_count",
        known("first_seq"), "title", "last_ts", known("last_seq"), "last_message")


def threads_at(changes: DataFrame, as_of: Instant, window_hours: int = 48, by: By = ()) -> DataFrame:
    """Threads of the window that ends at ``as_of``, a whole second that the stream's watermark has passed.

    A share that has messages then has changed within the window, so only changes of the window are read.
    """
    now = F.unix_timestamp(instant(as_of))
    rows = changes.where((F.col("moment") <= now) & (F.col("moment") > now - window_hours * HOUR))
    others = ["message_count", "first_seq", "title", "last_ts", "last_seq", "last_message"]
    keys = [*by_columns(by), "thread_id"]
    now_ = rows.groupBy(*keys, "share").agg(F.max_by(F.struct(*others), "moment").alias("_row")).select(*keys, "_row.*").where("message_count > 0")
    return now_.groupBy(*keys).agg(
        F.sum("message_count").alias("message_count"), F.min(F.struct("first_seq", "title")).alias("_first"),
        F.max(F.struct("last_ts", "last_seq", "last_message")).alias("_last"),
    ).select(*keys, F.col("_first.title").alias("title"), "message_count", F.col("_last.last_message").alias("last_message"),
             F.col("_last.last_ts").alias("last_ts"), F.col("_first.first_seq").alias("first_seq"))
