"""Review events as a stream: an append-only log with its rules, and the latest decision of each candidate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.review import latest_decision

CHECKED = "run_id string, candidate_id string, sequence long, decision string, reviewed_at timestamp, accepted boolean, reason string"


def check_log(events: DataFrame) -> DataFrame:
    """Each event with whether the log takes it: its number must be the run's next one and its time not before the
    last. State is one number and one time a run."""

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values(["sequence", "reviewed_at"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            now = int(pd.Timestamp(r.reviewed_at).value // 1000)
            reason = "sequence_gap" if r.sequence != last + 1 else "earlier_than_last" if now < at else None
            if reason is None:
                last, at = int(r.sequence), now
            out.append((r.run_id, r.candidate_id, r.sequence, r.decision, r.reviewed_at, reason is None, reason))
        state.update((last, at))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHECKED.split(", ")])

    return events.groupBy("run_id").applyInPandasWithState(
        check, CHECKED, "last long, at long", "append", GroupStateTimeout.NoTimeout
    )


def latest_decisions(events: DataFrame) -> DataFrame:
    """The last event of each candidate, kept up to date (complete or update mode)."""
    return latest_decision(events, ["run_id", "candidate_id"], ["sequence"], ["decision", "reviewed_at"])


def rejudge_stream(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Stored measurements, as they arrive, under a static table of thresholds (version, min_characters)."""
    joined = measured.crossJoin(F.broadcast(thresholds))  # a few versions, all of them
    return joined.withColumn("low_text", F.col("characters") < F.col("min_characters"))
