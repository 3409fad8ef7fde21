"""The review log as a stateful stream: numbers, chronology and the latest decision of each candidate.

State of a run is the number and time of its last event and a map from candidates to their latest decision, in the state
store of the stream's checkpoint; a restart goes on where it was, and an event that is earlier than the last one taken is
turned down whenever it comes. Decisions on hold can have a timer in event time: what is still on hold when it ends gives a
reminder. :func:`latest_from_state` reads the map from the checkpoint without running the stream.

State is kept by RocksDB; :func:`run_review_log` sets the provider for its own query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
LOG = "kind string, run_id string, candidate_id string, decision string, reviewed_at timestamp, arrived long, sequence long, event_id string, reason string"
_COLUMNS = [c.split()[0] for c in LOG.split(", ")]


def event_identity(run: str, candidate: str, decision: str, sequence: int, micros: int) -> str:
    """The id of an event: its parts name it."""
    parts = "\x00".join((run, candidate or "", decision or "", str(sequence), str(micros)))
    return "review:" + hashlib.sha256(parts.encode()).hexdigest()[:24]


class ReviewLog(StatefulProcessor):
    """Events of a run, in the order in which they arrived."""

    def __init__(self, remind_after: float | None = None) -> None:
        self.remind_after = remind_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence long, at long")
        self.latest = handle.getMapState("latest", "candidate_id string", "decision string, sequence long, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (run,) = key
        sequence, at = self.last.get() if self.last.exists() else (0, -(1 << 62))
        events = pd.concat(list(rows)).sort_values("arrived", kind="stable", ignore_index=True)
        whole = (events["reviewed_at"].notna() & events["candidate_id"].notna() & events["decision"].notna()).to_numpy()
        micros = events["reviewed_at"].to_numpy().astype("datetime64[us]").astype(np.int64)
        # What was turned down lay below the largest time before it, so it never is the largest.
        largest = np.maximum.accumulate(np.concatenate([[at], np.where(whole, micros, at)]))
        taken = whole & (micros >= largest[:-1])
        numbers = sequence + np.cumsum(taken)
        kept = events[taken].assign(sequence=numbers[taken], at=micros[taken])
        # State is another process: one call for each candidate and each time, not for each event.
        for e in kept.drop_duplicates("candidate_id", keep="last").itertuples(index=False):
            self.latest.updateValue((e.candidate_id,), (e.decision, int(e.sequence), int(e.at)))
        if self.remind_after is not None:
            for due in (kept.loc[kept["decision"] == "hold", "at"] // 1000).unique().tolist():
                self.handle.registerTimer(due + int(self.remind_after * 1000))
        if len(kept):
            self.last.update((int(numbers[-1]), int(largest[-1])))
        parts = (kept[c].tolist() for c in ("candidate_id", "decision", "sequence", "at"))
        identities = pd.Series(None, events.index, object)
        identities[taken] = [event_identity(run, *p) for p in zip(*parts, strict=True)]
        out = events.assign(
            kind=np.where(taken, "accepted", "rejected"),
            run_id=run,
            sequence=pd.Series(numbers, dtype="Int64").where(taken),
            event_id=identities,
            reason=pd.Series(np.where(whole, "earlier_than_last", "incomplete"), dtype=object).where(~taken, None),
        )
        yield out[_COLUMNS].astype({"arrived": "Int64", "reviewed_at": "datetime64[ns]"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (run,) = key
        due = expiredTimerInfo.getExpiryTimeInMs() - int(self.remind_after * 1000)
        out = [
            ("reminder", run, candidate, decision, pd.Timestamp(at * 1000), None, sequence, None, "on_hold")
            for (candidate,), (decision, sequence, at) in self.latest.iterator()
            if decision == "hold" and at // 1000 == due
        ]
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=_COLUMNS)
        return frame.astype({"arrived": "Int64", "sequence": "Int64", "reviewed_at": "datetime64[ns]"})

    def close(self) -> None:
        """Nothing is held outside the state."""


def review_log(events: DataFrame, remind_after: float | None = None, lateness: str = "0 seconds") -> DataFrame:
    """The log (see :data:`LOG`) of a stream (run_id, candidate_id, decision, reviewed_at, arrived). ``arrived`` orders
    events of a run. With ``remind_after`` seconds of event time a decision that is still on hold gives a reminder."""
    timed = events if remind_after is None else events.withWatermark("reviewed_at", lateness)
    mode = "none" if remind_after is None else "eventtime"
    return timed.groupBy("run_id").transformWithStateInPandas(ReviewLog(remind_after), LOG, "append", mode)


def run_review_log(events: DataFrame, out: str, checkpoint: str, remind_after: float | None = None) -> None:
    """Take everything that is there now into the log at ``out``, and stop. Called again, it goes on behind the last
    batch that was committed."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        log = review_log(events, remind_after)
        query = log.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before) if before else spark.conf.unset(PROVIDER[0])


def latest_from_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(run_id, candidate_id, decision, sequence) of every candidate, from the state of the last committed batch."""
    stored = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "latest").load()
    return stored.select("key.run_id", "user_map_key.candidate_id", "user_map_value.decision", "user_map_value.sequence")


def review_log_of(events: DataFrame) -> DataFrame:
    """The same log of a table that is there as a whole."""
    order = Window.partitionBy("run_id").orderBy("arrived")
    whole = F.col("reviewed_at").isNotNull() & F.col("candidate_id").isNotNull() & F.col("decision").isNotNull()
    # What was turned down lay below the largest time before it, so it never is the largest.
    before = F.max(F.when(whole, F.col("reviewed_at"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    reason = F.when(~whole, "incomplete").when(F.col("reviewed_at") < before, "earlier_than_last")
    judged = events.withColumn("reason", reason)
    number = F.count(F.when(F.col("reason").isNull(), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("sequence", F.when(F.col("reason").isNull(), number)).select(
        F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("kind"), "run_id", "candidate_id", "decision", "reviewed_at", "arrived", "sequence", "reason"
    )
