"""The metric suite of a pilot run: named ratios over its tables.

Every function returns rows (section, metric, numerator, denominator, value, status, reason), made by aggregates of one
row. A metric that cannot be told is unavailable with a reason, never zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X

#: States of a node that count as success, the state of one that was not tried, and how many ranked topics
#: are looked at.
NODE_SUCCESS = ("success", "partial", "awaiting_review")
NODE_NOT_RUN = "not_run"
TOP = 5


def metric(section: str, name: str, numerator: Column, denominator: Column, otherwise: str = "zero_denominator") -> Column:
    """Struct of a ratio; where the denominator is zero or null it is unavailable for the reason ``otherwise``."""
    n, d = numerator.cast("long"), denominator.cast("long")
    known = F.coalesce(d > 0, F.lit(False))
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(name).alias("metric"),
        n.alias("numerator"),
        d.alias("denominator"),
        F.round(F.when(known, n / d), 6).alias("value"),
        F.when(known, "available").otherwise("unavailable").alias("status"),
        F.when(~known, otherwise).alias("reason"),
    )


def unavailable(section: str, name: str, reason: str) -> Column:
    return metric(section, name, F.lit(None), F.lit(None), reason)


def _rows(sums: DataFrame, *metrics: Column) -> DataFrame:
    return sums.select(F.inline(F.array(*metrics)))


def data_metrics(files: DataFrame, readable: Column, essential: Sequence[Column]) -> DataFrame:
    """``files`` has one row for each file of a supported kind; ``essential`` are its fields that must be there."""
    each = files.select(readable.alias("ok"), sum((c.isNull().cast("int") for c in essential), F.lit(0)).alias("missing"))
    sums = each.agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("ok"),
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("missing"))), F.lit(0)).alias("missing"),
    )
    return _rows(
        sums,
        metric("data", "processing_success_rate", F.col("ok"), F.col("n")),
        unavailable("data", "publication_type_classification_accuracy", "no_reviewed_types"),
        metric("data", "essential_metadata_missing_rate", F.col("missing"), F.col("ok") * len(essential)),
    )


def search_metrics(results: DataFrame) -> DataFrame:
    """``results`` (query, wanted_type, publication_id, publication_type): a null ``wanted_type`` asks for no type."""
    typed = F.col("wanted_type").isNotNull()
    place = F.struct("query", "publication_id")
    sums = results.agg(
        F.count_if(typed).alias("typed"),
        F.count_if(typed & F.col("wanted_type").eqNullSafe(F.col("publication_type"))).alias("fit"),
        F.count_if(~typed).alias("free"),
        F.count_distinct(F.when(~typed, place)).alias("kinds"),
    )
    return _rows(
        sums,
        unavailable("search", "recall_at_k", "no_reviewed_queries"),
        metric("search", "publication_type_filter_accuracy", F.col("fit"), F.col("typed")),
        metric("search", "result_duplicate_rate", F.col("free") - F.col("kinds"), F.col("free")),
    )


def generation_metrics(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """``candidates`` (title, question, signal_ids, publication_ids) and ``signals`` (title)."""
    shown = lambda c: X.canonical_text(F.coalesce(F.col(c), F.lit("")))
    each = candidates.select(
        shown("title").alias("title"),
        shown("question").alias("question"),
        (F.size(F.coalesce("signal_ids", F.array())) > 0).alias("signal"),
        (F.size(F.coalesce("publication_ids", F.array())) > 0).alias("publication"),
    )
    # Candidates of one title and question are one row before they meet the signals.
    kinds = each.groupBy("title", "question").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("signal") | F.col("publication")).alias("grounded"),
        F.count_if("publication").alias("linked"),
    )
    known = signals.select(shown("title").alias("title")).distinct().withColumn("news", F.lit(True))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = kinds.join(known, "title", "left").agg(
        total("n").alias("n"),
        F.count("*").alias("kinds"),
        total("grounded").alias("grounded"),
        total("linked").alias("linked"),
        total(F.when(F.col("news"), F.col("n"))).alias("news"),
    )
    n = F.col("n")
    return _rows(
        sums,
        metric("generation", "evidence_id_inclusion_rate", F.col("grounded"), n),
        metric("generation", "duplicate_candidate_rate", n - F.col("kinds"), n),
        metric("generation", "simple_news_title_rate", F.col("news"), n),
        metric("generation", "internal_publication_link_rate", F.col("linked"), n),
    )


def evaluation_metrics(evaluations: DataFrame) -> DataFrame:
    """``evaluations`` (results, failures, missing): how many criteria of each candidate were judged, failed and lack a
    result; and how many candidates with failures kept some result."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    failed = F.col("failures") > 0
    sums = evaluations.agg(
        total("results").alias("results"),
        total("failures").alias("failures"),
        total("missing").alias("missing"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & (F.col("results") > 0)).alias("recovered"),
    )
    results = F.col("results")
    return _rows(
        sums,
        unavailable("evaluation", "direct_duplicate_detection_accuracy", "no_reviewed_duplicates"),
        unavailable("evaluation", "official_material_gap_detection_accuracy", "no_reviewed_gaps"),
        metric("evaluation", "schema_success_rate", results, results + F.col("failures")),
        metric("evaluation", "criterion_coverage_rate", results, results + F.col("missing")),
        metric("orchestration", "partial_failure_recovery_rate", F.col("recovered"), F.col("failed"), "no_partial_failure"),
    )


def audit_metrics(nodes: DataFrame, audit: DataFrame) -> DataFrame:
    """``nodes`` (status) and ``audit`` (retry_count, resumed, reproduced) of at most one row; null is not recorded."""
    tried = F.col("status") != NODE_NOT_RUN
    states = nodes.agg(
        F.count_if(tried).alias("tried"), F.count_if(F.col("status").isin(*NODE_SUCCESS)).alias("ok")
    )
    found = audit.agg(*[F.max(F.col(c).cast("long")).alias(c) for c in ("retry_count", "resumed", "reproduced")])
    told = lambda name, c, reason: metric(
        "orchestration", name, F.col(c), F.when(F.col(c).isNotNull(), 1), reason
    )
    return _rows(
        states.crossJoin(F.broadcast(found)),  # one row each
        metric("orchestration", "node_success_rate", F.col("ok"), F.col("tried"), "no_node_states"),
        told("retry_count", "retry_count", "no_retry_record"),
        told("interrupt_resume", "resumed", "not_resumed_yet"),
        told("reproducibility", "reproduced", "no_second_run"),
    )


def expert_metrics(ranked: DataFrame) -> DataFrame:
    """``ranked`` (rank, evidence_ids, criterion_scores, explanation); the first ``TOP`` ranks are looked at."""
    top = ranked.orderBy("rank").limit(TOP)
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    sums = top.agg(
        F.count("*").alias("n"),
        F.count_if(filled("evidence_ids")).alias("evidence"),
        F.count_if(filled("criterion_scores") & (F.length(F.coalesce("explanation", F.lit(""))) > 0)).alias("trace"),
    )
    return _rows(
        sums,
        metric("expert", "top_five_evidence_coverage", F.col("evidence"), F.col("n")),
        metric("expert", "top_five_score_trace_coverage", F.col("trace"), F.col("n")),
    )
