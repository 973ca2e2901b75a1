"""Costly work on rows in chunks that are finished one by one, so a job that was lost half way does only the rest.

A job is a folder.  All that decides anything in it is a small file made exclusively (``sources.commits``):

* ``plan.json``: the rows as they were when the job began (``asked``, by chunk), so that a later run works on the same ones;
* ``claims/<chunk>/<n>.json``: who works on a chunk.  Another run leaves it alone until the claim is older than the lease;
* ``done/<chunk>.json``: the folder with the chunk's results.  Folders that no such file names do not count.

If a claim is taken over from a run that is slow but alive, calls are made twice, but one of the two results counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..columns import quoted
from ..sources.commits import Create, creator, names, read

CHUNK_ROWS = 50_000
POLL = 1.0


def in_chunks(rows: DataFrame, key: Sequence[str], path: str, make: Callable[[DataFrame], DataFrame], chunk_rows: int = CHUNK_ROWS,
              lease: float = 3600, writer: str | None = None, at_once: int = 2, create: Create | None = None) -> DataFrame:
    """``make(rows)``, a result for each row, as a table; finished chunks of the job in ``path`` are not made again.

    ``key``: columns that are unique together; rows are dealt to chunks of about ``chunk_rows`` by their hash, and each chunk is
    a Spark job over all executors, ``at_once`` of them together.  ``rows`` are only looked at by the first run.  A run that names
    the ``writer`` of an earlier one goes on with its chunks at once; chunks of other writers are waited for, and
    taken over ``lease`` seconds after they were claimed.
    """
    return _Job(rows.sparkSession, path, create, writer or uuid.uuid4().hex, lease).run(rows, key, make, chunk_rows, at_once)


class _Job:
    def __init__(self, spark: SparkSession, path: str, create: Create | None, writer: str, lease: float):
        self.spark, self.path, self.writer, self.lease = spark, path.rstrip("/"), writer, lease
        self.create = create or creator(spark, self.path)

    def entry(self, name: str) -> dict | None:
        content = read(self.spark, f"{self.path}/{name}")
        return None if content is None else json.loads(content)

    def enter(self, name: str, **entry) -> bool:
        return self.create(f"{self.path}/{name}", json.dumps({**entry, "made_by": uuid.uuid4().hex}).encode())

    def plan(self, rows: DataFrame, key: Sequence[str], chunk_rows: int) -> dict:
        plan = self.entry("plan.json")
        if plan is None:
            folder = f"asked/{uuid.uuid4().hex}"
            chunk = F.pmod(F.xxhash64(*(quoted(c) for c in key)), F.lit(max(1, -(-rows.count() // chunk_rows)))).cast("int")
            rows.withColumn("_chunk", chunk).hint("rebalance", "_chunk").write.partitionBy("_chunk").parquet(f"{self.path}/{folder}")
            chunks = sorted(int(n.split("=")[1]) for n in names(self.spark, f"{self.path}/{folder}") if n.startswith("_chunk="))
            self.enter("plan.json", folder=folder, chunks=chunks, schema=rows.schema.json())
            plan = self.entry("plan.json")  # of the run that was first
        return plan

    def claimed(self, chunk: int) -> bool:
        """Whether the chunk is this run's to make."""
        folder = f"{self.path}/claims/{chunk}"
        made = names(self.spark, folder)
        numbers = sorted(int(n.removesuffix(".json")) for n in made if n.removesuffix(".json").isdigit())
        if numbers:
            last = f"{numbers[-1]:06d}.json"
            mine = self.entry(f"claims/{chunk}/{last}")["writer"] == self.writer
            if not mine and time.time() - made[last] < self.lease:
                return False
        return self.enter(f"claims/{chunk}/{(numbers or [0])[-1] + 1:06d}.json", writer=self.writer)

    def finish(self, chunk: int, plan: dict, make: Callable[[DataFrame], DataFrame]) -> None:
        if not self.claimed(chunk):
            return
        kinds = StructType.fromJson(json.loads(plan["schema"]))
        rows = self.spark.read.schema(kinds).parquet(f"{self.path}/{plan['folder']}/_chunk={chunk}")
        made, folder = make(rows), f"made/{uuid.uuid4().hex}"
        made.write.parquet(f"{self.path}/{folder}")
        self.enter(f"done/{chunk}.json", folder=folder)

    def missing(self, plan: dict) -> list[int]:
        done = names(self.spark, f"{self.path}/done")
        return [c for c in plan["chunks"] if f"{c}.json" not in done]

    def run(self, rows: DataFrame, key: Sequence[str], make: Callable[[DataFrame], DataFrame], chunk_rows: int, at_once: int) -> DataFrame:
        plan = self.plan(rows, key, chunk_rows)
        while todo := self.missing(plan):
            with ThreadPoolExecutor(at_once) as pool:
                jobs = [pool.submit(self.finish, chunk, plan, make) for chunk in todo]
                try:
                    for job in jobs:
                        job.result()
                except BaseException:
                    pool.shutdown(cancel_futures=True)
                    raise
            if self.missing(plan) == todo:
                time.sleep(POLL)  # others are at work
        kinds = StructType.fromJson(json.loads(plan["schema"]))
        result = make(self.spark.createDataFrame([], kinds)).schema
        folders = [self.entry(f"done/{c}.json")["folder"] for c in plan["chunks"]]
        if not folders:
            return self.spark.createDataFrame([], result)
        return self.spark.read.schema(result).parquet(*(f"{self.path}/{f}" for f in folders))
