"""Run ledger around jobs: a running row first, then counts taken while the job writes.

The ledger is a table of appended rows, two for a run that ended: nothing is updated in place, and a
driver that dies leaves its running row behind, which reads as interrupted.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COUNTS = ["n_target", "n_fetched", "n_changed", "n_error", "bytes"]
RUN = ("run_id bigint, job string, scope string, started_at timestamp, ended_at timestamp, "
       + "".join(f"{c} bigint, " for c in COUNTS) + "note string, status string")


class Run:
    """What a job's context hands out: its frames are written through it, and so counted."""

    def __init__(self) -> None:
        self.seen: list[Observation] = []

    def write(self, df: DataFrame, sink: Callable[[DataFrame], None], ok: Column, changed: Column | None = None, size: Column | None = None) -> None:
        """Write a frame with ``sink``, counting on the way: rows, rows that are ``ok``, of these the
        ``changed`` ones and their bytes. The counts are metrics of the write itself, no pass more."""
        good = F.coalesce(ok, F.lit(False))
        seen = Observation()
        sink(df.observe(
            seen, F.count(F.lit(1)).alias("n_target"), F.count_if(good).alias("n_fetched"),
            F.count_if(good & F.coalesce(changed if changed is not None else F.lit(False), F.lit(False))).alias("n_changed"),
            F.count_if(~good).alias("n_error"),
            F.coalesce(F.sum(F.when(good, size if size is not None else F.lit(0))), F.lit(0)).cast("bigint").alias("bytes")))
        self.seen.append(seen)                           # a sink that failed isn't waited for

    def counts(self) -> dict[str, int]:
        got = [s.get for s in self.seen]
        return {c: sum(g[c] for g in got) for c in COUNTS}


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _add(self, **row) -> None:
        names = [c.split()[0] for c in RUN.split(", ")]
        self.spark.createDataFrame([tuple(row.get(n) for n in names)], RUN).coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def job(self, job: str, scope: str) -> Iterator[Run]:
        """Record what is done inside as one run: ok, failed (some rows weren't), or aborted (an
        exception, which goes on; its counts are unknown)."""
        now = lambda: datetime.now(timezone.utc)
        began = now()
        row = {"run_id": time.time_ns() // 1000, "job": job, "scope": scope, "started_at": began}
        self._add(**row, status="running")
        run = Run()
        try:
            yield run
        except BaseException:
            self._add(**row, ended_at=now(), status="aborted")
            raise
        counts = run.counts()
        took = f"{(now() - began).total_seconds():.0f}s"
        self._add(**row, ended_at=now(), **counts, note=took, status="failed" if counts["n_error"] else "ok")

    def runs(self) -> DataFrame:
        """One row a run: its last state, 'running' where none followed."""
        rows = self.spark.read.schema(RUN).parquet(self.path)
        rest = [c for c in rows.columns if c != "run_id"]
        return (rows.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.col("status") != "running").alias("r"))
                .select("run_id", "r.*"))
