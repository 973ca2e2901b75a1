"""The summary table as immutable parquet folders and a log of versions, in a shared folder.

Parquet cannot be overwritten while it is read, so a change never touches existing
files.  It writes a folder under ``data`` and then one small entry under ``log``,
which says all there is to a version: the folders it consists of, the highest id ever
given out, and the tags of changes that were made.  Folders are

* ``full``: rows of the table with all earlier changes, in sub-folders by the hash of their keys (buckets);
* ``delta``: upserted rows; a later row wins over an earlier one of its key;
* ``delete``: ids that are gone.

A look-up for some keys (``read_for``) opens the buckets that can hold them, and in these and the deltas parquet's Bloom
filters and statistics tell which row groups are read.  Entries are numbered and made exclusively (``sources.commits``): of
two writers one gets a number and the other, told so, takes the next.  Rows of a delta carry ids counted from one; where
they begin is in the entry, so nobody writes anew.  A folder without an entry
does not count, whatever executors are lost.  After ``MOST_FOLDERS`` changes the buckets with changed keys are written
anew, the others stay where they are; if that leaves many folders, the whole table is.  ``remove_old`` deletes what no
version needs any more.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..columns import quoted
from ..entities import SUMMARY
from ..operators import summaries as ops
from .commits import Create, creator

_ENTRY = re.compile(r"^(\d+)\.json$")
MOST_FOLDERS = 32
MOST_TAGS = 1_000
MOST_BUCKETS_NAMED = 10
NOTHING = {"number": 0, "live": [], "last_id": 0, "tags": [], "parts": {}}
# Written with every folder of rows; a filter takes the room that its row group's keys need.
BLOOM = {"parquet.bloom.filter.enabled#email_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


class SummaryStore:
    """``by``: the columns that separate accounts, with their types (``{"account_id": "bigint"}``).

    ``buckets`` is for full tables that are written from now on; one bucket should be some hundred MB at most.
    ``create`` makes a file exclusively, where the path's file system is none that ``sources.commits`` knows.
    """

    def __init__(self, spark: SparkSession, path: str, by: Mapping[str, str] | None = None, buckets: int = 16,
                 create: Create | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.by = list(by or {})
        self.kinds = dict(by or {})
        self.buckets = buckets
        self.create = create or creator(spark, self.path)
        self.schema = ", ".join([*(f"`{c}` {kind}" for c, kind in (by or {}).items()), SUMMARY])

    # The log ---------------------------------------------------------------------

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _list(self, folder: str) -> list:
        fs = self._fs()
        return list(fs.listStatus(self._at(folder))) if fs.exists(self._at(folder)) else []

    def _latest(self) -> dict:
        numbers = [int(m[1]) for s in self._list("log") if (m := _ENTRY.match(s.getPath().getName()))]
        if not numbers:
            return NOTHING
        stream = self._fs().open(self._at("log", f"{max(numbers):012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {"number": max(numbers), "parts": {}, **json.loads(text)}

    def _create(self, number: int, entry: dict) -> bool:
        """The entry of the log, or False where there is one of this number."""
        return self._create_new("log", f"{number:012d}.json", entry)

    def _create_new(self, folder: str, name: str, entry: dict) -> bool:
        """A file with the entry, complete and at once, or False where there is one of this name."""
        entry = {**entry, "writer": uuid.uuid4().hex}  # no two entries are equal
        return self.create(f"{self.path}/{folder}/{name}", json.dumps(entry).encode())

    def _commit(self, change, tag: str | None = None, on: int | None = None) -> bool:
        """Add the version that ``change(latest)`` makes of the latest one: its live folders, last id and the buckets of new folders.

        False where ``tag`` is known, or where the latest version is not ``on``.
        """
        while True:
            latest = self._latest()
            if (tag and tag in latest["tags"]) or (on is not None and latest["number"] != on):
                return False
            live, last_id, *parts = change(latest)
            tags = [*latest["tags"], tag][-MOST_TAGS:] if tag else latest["tags"]
            known = latest["parts"] | (parts[0] if parts else {})
            parts = {folder: known[folder] for _, folder, _ in live if folder in known}
            if self._create(latest["number"] + 1, {"live": live, "last_id": last_id, "tags": tags, "parts": parts}):
                break
        if len(live) > MOST_FOLDERS:
            self.fold()
        return True

    # The ledger: what was done under a tag -----------------------------------------

    def entered(self, tag: str, end: str = "json") -> dict | None:
        """What was entered under the tag, or None."""
        at = self._at("ledger", f"{quote(tag, safe='')}.{end}")
        if not self._fs().exists(at):
            return None
        stream = self._fs().open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def enter(self, tag: str, entry: dict) -> dict:
        """The entry that counts for the tag: this one, or that of a writer who was first."""
        self._create_new("ledger", f"{quote(tag, safe='')}.json", entry)
        return self.entered(tag)

    def settle(self, tag: str, entry: dict) -> None:
        """Make the entry's folder (``folder``, ``ids``; none if ``folder`` is null) a delta, once and for all.

        The log remembers the latest tags; of older ones a note says which version had them.
        """
        done = self.entered(tag, "done")
        if done is None or self._latest()["number"] < done["number"]:
            if entry["folder"]:
                self.add(entry["folder"], entry["ids"], tag)
            self._create_new("ledger", f"{quote(tag, safe='')}.done", {"number": self._latest()["number"]})

    # Folders ---------------------------------------------------------------------

    def _data(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.options(**BLOOM).parquet(f"{self.path}/{folder}")
        return folder

    def _bucket(self, of: int, key: Column | str = "email_id") -> Column:
        """The bucket of a key; the account's columns belong to it."""
        account = [quoted(c).cast(kind) for c, kind in self.kinds.items()]
        return F.pmod(F.xxhash64(*account, key), F.lit(of)).cast("int")

    def _row_bucket(self, of: int) -> Column:
        """The bucket of a row; rows without a key, which no look-up finds, are spread."""
        return self._bucket(of, F.coalesce("email_id", F.col("id").cast("string")))

    def _bucketed(self, rows: DataFrame, of: int) -> tuple[str, dict]:
        """The rows in a new folder, and what the log says about it: its buckets."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = rows.withColumn("bucket", self._row_bucket(of)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "email_id")
        rows.write.options(**BLOOM).partitionBy("bucket").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._list(folder)]
        return folder, {folder: {"of": of, "has": sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))}}

    def _load(self, latest: dict, kind: str, wanted: Mapping[int, set[int]] | None = None) -> DataFrame | None:
        """Rows of the version's folders; of those in buckets the wanted ones, by the number of buckets."""
        found = None
        for one, folder, base in latest["live"]:
            if one != kind:
                continue
            paths, part = [folder], latest["parts"].get(folder)
            if part:
                paths = [f"{folder}/bucket={b}" for b in part["has"] if wanted is None or b in wanted[part["of"]]]
            if paths:
                rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in paths))
                rows = rows.withColumn("id", F.col("id") + F.lit(base).cast("bigint"))
                found = rows if found is None else found.unionByName(rows)
        return found

    def _table(self, latest: dict, wanted: Mapping[int, set[int]] | None = None, keys: Column | None = None) -> DataFrame:
        live = latest["live"]
        rows, changes = self._load(latest, "full", wanted), self._load(latest, "delta")
        if keys is not None:
            rows, changes = (df if df is None else df.where(keys) for df in (rows, changes))
        if changes is not None:
            newest = ops.latest_per_email(changes, self.by)
            rows = newest if rows is None else ops.without_keys(rows, changes, self.by).unionByName(newest)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        gone = [f"{self.path}/{folder}" for kind, folder, _ in live if kind == "delete"]
        if gone:
            rows = rows.join(self.spark.read.schema("id bigint").parquet(*gone), "id", "left_anti")
        return rows.select(*self.by, *ops.STORED)

    def read(self) -> DataFrame:
        """The current table.

        Only the deltas are searched for the latest row of a key.  The full table just
        loses the keys they replace, by an anti join that is a broadcast as long as
        the deltas are small.
        """
        return self._table(self._latest())

    def read_for(self, keys: DataFrame) -> DataFrame:
        """The rows of the current table for a look-up of ``keys``, from the folders that can hold them."""
        return self._near(self._latest(), keys)

    def _near(self, latest: dict, keys: DataFrame) -> DataFrame:
        """The version's rows of ``keys`` (the account columns, ``email_id``), and others that lie near them.

        One pass over the keys gives a row for each bucket that they meet, with its least and greatest key.  Only these
        buckets are opened.  If there are few, the scans are told the keys' ranges one by one (a bucket met by one key: that
        key, which Bloom filters answer), and else from the least to the greatest of all.  NULL is no key.
        """
        wanted, ranges = {}, []
        keyed = keys.where(F.col("email_id").isNotNull())
        for of in {p["of"] for p in latest["parts"].values()} or {self.buckets}:
            met = keyed.groupBy(self._bucket(of).alias("bucket")).agg(F.min("email_id").alias("low"), F.max("email_id").alias("high")).collect()
            wanted[of] = {r.bucket for r in met}
            ranges = [(r.low, r.high) for r in met]
        if len(ranges) > MOST_BUCKETS_NAMED:
            ranges = [(min(low for low, _ in ranges), max(high for _, high in ranges))]
        key, near = F.col("email_id"), F.lit(False)
        for low, high in ranges:
            near |= key == low if low == high else key.between(low, high)
        return self._table(latest, wanted, near)

    def last_id(self) -> int:
        """Highest id ever given out, also to rows deleted since: ids are not used twice."""
        return self._latest()["last_id"]

    # Changes ---------------------------------------------------------------------

    def _full(self, folder: str, on: int | None = None, parts: dict | None = None) -> bool:
        highest = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.max("id")).first()[0] or 0
        return self._commit(lambda latest: ([["full", folder, 0]], max(latest["last_id"], highest), parts or {}), on=on)

    def write(self, rows: DataFrame) -> None:
        """Replace the whole table."""
        folder, parts = self._bucketed(rows.select(*self.by, *ops.STORED), self.buckets)
        self._full(folder, parts=parts)

    def add(self, folder: str, ids: int, tag: str | None = None, on: int | None = None) -> bool:
        """Make a folder below the store's, whose rows have ids from 1 to ``ids``, the newest delta."""
        def change(latest):
            return [*latest["live"], ["delta", folder, latest["last_id"]]], latest["last_id"] + ids
        return self._commit(change, tag, on)

    def _delta(self, new: DataFrame, tag: str | None = None, on: int | None = None) -> bool:
        return self.add(*self._numbered(new), tag, on)

    def _numbered(self, new: DataFrame) -> tuple[str, int]:
        folder = self._data(ops.latest_per_email(ops.number_new(new, 0, self.by), self.by))
        return folder, self.spark.read.parquet(f"{self.path}/{folder}").agg(F.max("id")).first()[0] or 0

    def insert(self, new: DataFrame) -> None:
        """Append; a key that is stored already, or twice in ``new``, is an error."""
        while True:
            latest = self._latest()
            ops.check_insert(self._near(latest, new), new, self.by)
            if self._delta(new, on=latest["number"]):
                return

    def upsert(self, new: DataFrame, tag: str | None = None) -> None:
        """Insert or replace.  A call repeated with the same ``tag`` does nothing, however much was written in between."""
        if not tag:
            self._delta(new)
            return
        entry = self.entered(tag)
        if entry is None:
            folder, highest = self._numbered(new)
            entry = self.enter(tag, {"folder": folder, "ids": highest})
        self.settle(tag, entry)

    def delete(self, ids: DataFrame) -> None:
        """Only the ids are written; rows lose them when they are read."""
        folder = self._data(ids.select(F.col("id").cast("bigint").alias("id")).where("id is not null").distinct())
        self._commit(lambda latest: ([*latest["live"], ["delete", folder, 0]], latest["last_id"]))

    def clear(self) -> None:
        self._commit(lambda latest: ([], latest["last_id"]))

    # Upkeep ----------------------------------------------------------------------

    def fold(self, tries: int = 5) -> bool:
        """Write the buckets that have changed keys anew; the whole table if that leaves many folders.

        Deletes stay, as other buckets may have their ids.  False if others were faster each time.
        """
        for _ in range(tries):
            latest = self._latest()
            full = [folder for kind, folder, _ in latest["live"] if kind == "full"]
            deletes = [one for one in latest["live"] if one[0] == "delete"]
            changes = self._load(latest, "delta")
            kinds = {latest["parts"].get(folder, {}).get("of") for folder in full}
            if changes is None or len(kinds) != 1 or None in kinds or len(full) + 1 + len(deletes) > MOST_FOLDERS // 2:
                return self.compact(tries)
            (of,) = kinds
            touched = {r[0] for r in changes.select(self._row_bucket(of)).distinct().collect()}
            folder, parts = self._bucketed(self._table(latest, {of: touched}), of)
            left = {f: [b for b in latest["parts"][f]["has"] if b not in touched] for f in full}
            parts |= {f: {"of": of, "has": has} for f, has in left.items()}
            live = [*(["full", f, 0] for f in full if left[f]), ["full", folder, 0], *deletes]
            if self._commit(lambda now: (live, now["last_id"], parts), on=latest["number"]):
                return True
        return False

    def compact(self, tries: int = 5) -> bool:
        """Fold the latest version into one full table; False if others were faster each time."""
        for _ in range(tries):
            latest = self._latest()
            if [kind for kind, *_ in latest["live"]] in ([], ["full"]):
                return True
            folder, parts = self._bucketed(self._table(latest), self.buckets)
            if self._full(folder, on=latest["number"], parts=parts):
                return True
        return False

    def remove_old(self, hours: float = 24 * 7) -> int:
        """Delete folders and entries older than ``hours`` that the latest version does not need.

        It is the time that a reader of an older version, or a writer that has no entry yet, may take.
        """
        latest, fs, removed = self._latest(), self._fs(), 0
        needed = {folder.split("/")[1] for _, folder, _ in latest["live"]} | {f"{latest['number']:012d}.json"}
        for status in [*self._list("data"), *self._list("log")]:
            old = status.getModificationTime() < (time.time() - hours * 3600) * 1000
            if old and status.getPath().getName() not in needed:
                removed += fs.delete(status.getPath(), True)
        return removed
