"""Review logs, project states and their integrity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The transitions of a project.
TRANSITIONS = (
    ("queued", "running"),
    ("queued", "failed"),
    ("running", "awaiting_human_review"),
    ("running", "failed"),
    ("awaiting_human_review", "approved"),
    ("awaiting_human_review", "rejected"),
    ("awaiting_human_review", "held"),
)


#: The decisions that approve a candidate.
APPROVALS = ("approve", "approve_with_edits")


def latest_decision(events: DataFrame, key: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The last event of each key, as an aggregate."""
    last = F.max_by(F.struct(*keep), F.struct(*order)).alias("__last")
    return events.groupBy(*key).agg(last).select(*key, "__last.*")


def gate_status(
    candidates: DataFrame, latest: DataFrame, run: str, key: Sequence[str], undecided: Sequence[str] = ("hold",), approvals: Sequence[str] = APPROVALS
) -> DataFrame:
    """Runs with a candidate that has no decision, or one of ``undecided``, await review; else those with an approval are
    ready; the rest are completed."""
    joined = candidates.join(latest, list(key), "left")
    counts = joined.groupBy(run).agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("decision").isNull() | F.col("decision").isin(*undecided)).alias("pending"),
        F.count_if(F.col("decision").isin(*approvals)).alias("approved"),
    )
    status = F.when(F.col("pending") > 0, "awaiting_review").when(F.col("approved") > 0, "ready").otherwise("completed")
    return counts.withColumn("status", status)


def log_faults(events: DataFrame, run: str, sequence: str, at: str, event_id: str) -> DataFrame:
    """Rows (run, faults by kind) of append-only logs: numbers must count from 1 and times must not go back."""
    order = Window.partitionBy(run).orderBy(sequence, event_id)
    seen = events.withColumns(
        {"__n": F.row_number().over(order), "__before": F.lag(at).over(order)}
    )
    return seen.groupBy(run).agg(
        F.count_if(F.col(sequence) != F.col("__n")).alias("gaps"),
        F.count_if(F.col(at) < F.col("__before")).alias("backwards"),
        (F.count("*") - F.count_distinct(event_id)).alias("repeated_ids"),
    )


def overlay(base: DataFrame, edits: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """``base`` with each field replaced by the edit's value where that is not null. ``fields`` maps a field to its edit."""
    renamed = edits.select(key, *[F.col(e).alias(f"__{f}") for f, e in fields.items()])
    joined = base.join(renamed, key, "left")
    return joined.select(
        *[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def transition_faults(history: DataFrame, project: str, revision: str, status: str) -> DataFrame:
    """Steps (project, revision, from, to) that the state machine does not allow."""
    order = Window.partitionBy(project).orderBy(revision)
    steps = history.select(project, revision, F.lag(status).over(order).alias("from_status"), F.col(status).alias("to_status"))
    allowed = history.sparkSession.createDataFrame(list(TRANSITIONS), "from_status string, to_status string")
    first = F.col("from_status").isNull() & (F.col("to_status") == "queued")
    return steps.filter(~first).join(F.broadcast(allowed), ["from_status", "to_status"], "left_anti").select(
        project, revision, "from_status", "to_status"
    )


def event_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256), 1, 24)
