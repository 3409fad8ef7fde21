"""Claiming each job once, from streams that may be replayed and by writers that may race.

The claims of a table of jobs are versions of a folder: each holds the claims that one batch won, and its pointer can be
made once. A batch wins what no earlier version holds. It publishes only if no other version came since it looked; if one did, it looks
again, so of two claimers of a job one wins whatever their order. The pointer names the last batch of each stream, and a batch
that is not newer is passed over: a replay changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.ranking import best_per_group
from corvane.sources.versions import POINTERS, Conflict, Version, Versions
from corvane.storage import discard

CLAIMS = "job_id string, claimer string, claimed_at timestamp, revision long"


class ClaimLog:
    """Claims on the jobs of ``jobs()``, a table (job_id, status, revision); only queued jobs can be claimed."""

    def __init__(self, spark: SparkSession, root: str, jobs: Callable[[], DataFrame]) -> None:
        self.spark, self.root, self.jobs = spark, root, jobs
        self.versions = Versions(spark, root)

    def claims(self, upto: Version | None = None) -> DataFrame:
        """All claims up to a version, or all there are."""
        last = upto or self.versions.current()
        if last is None:
            return self.spark.createDataFrame([], CLAIMS)
        pointers = self.spark.read.format("binaryFile").load(f"{self.root}/{POINTERS}")
        number = F.element_at(F.split("path", "/"), -1).cast("long")
        kept = pointers.filter(number <= last.number).select("content").collect()  # one small row a batch
        folders = [json.loads(bytes(r.content))["folder"] for r in kept]
        return self.spark.read.schema(CLAIMS).parquet(*[f"{self.root}/{f}" for f in folders])

    def claim(self, wanted: DataFrame, stream: str, batch: int, attempts: int = 20) -> Version | None:
        """Give each free job of ``wanted`` (job_id, claimer, claimed_at) to its first claimer, by time and name. None if this
        batch of this stream was taken before."""
        for _ in range(attempts):
            seen = self.versions.current()
            done = seen.about["batches"] if seen else {}
            if done.get(stream, -1) >= batch:
                return None
            free = self.jobs().filter("status = 'queued'").select("job_id", (F.col("revision") + 1).alias("revision"))
            free = free.join(self.claims(seen), "job_id", "left_anti")
            asked = wanted.filter("job_id IS NOT NULL AND claimer IS NOT NULL AND claimed_at IS NOT NULL")
            first = best_per_group(asked, ["job_id"], [F.col("claimed_at"), F.col("claimer")], ["claimer", "claimed_at"])
            path = self.versions.fresh()
            first.join(free, "job_id").select("job_id", "claimer", "claimed_at", "revision").write.parquet(path)
            try:
                return self.versions.publish(path, seen, batches=done | {stream: batch})
            except Conflict:
                discard(self.spark, path)
        raise Conflict(f"{self.root}: {attempts} attempts met other writers")

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``; ``stream`` names the stream across its restarts."""
        return lambda batch, number: self.claim(batch, stream, number) and None

    def state(self) -> DataFrame:
        """The jobs as the claims leave them: claimed ones are running, one revision on."""
        won = self.claims().withColumnRenamed("revision", "__revision")
        joined = self.jobs().join(won, "job_id", "left")
        held = F.col("claimer").isNotNull()
        return joined.select(
            "job_id",
            F.when(held, "running").otherwise(F.col("status")).alias("status"),
            F.coalesce("__revision", "revision").alias("revision"),
            "claimer",
        )
