"""Evaluations, penalised scores and diversified rankings of candidates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X

#: Weights of the criteria, penalty points and deductions for repeats.
WEIGHTS = {
    "policy_relevance": 0.2,
    "timeliness": 0.1,
    "novelty": 0.2,
    "public_evidence_sufficiency": 0.15,
    "policy_impact": 0.15,
    "feasibility": 0.1,
    "output_fit": 0.1,
}
PENALTIES = {
    "direct_duplicate": 20.0,
    "official_material_missing": 12.0,
    "scope_too_broad": 8.0,
    "foreign_case_only": 6.0,
    "insufficient_evidence_ids": 10.0,
    "low_confidence": 8.0,
    "missing_criterion": 5.0,
}
REPEATS = {"domain": 6.0, "country": 4.0, "output": 3.0, "horizon": 2.0}


@dataclass(frozen=True)
class RankingConfig:
    weights: Mapping[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    penalties: Mapping[str, float] = field(default_factory=lambda: dict(PENALTIES))
    repeats: Mapping[str, float] = field(default_factory=lambda: dict(REPEATS))
    minimum_evidence: int = 2
    low_confidence: float = 0.5
    high_score_without_evidence: float = 60.0

    def __post_init__(self) -> None:
        if abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("weights must add up to 1")


def evidence_gate(evaluations: DataFrame, limit: float = 60.0) -> DataFrame:
    """Scores over ``limit`` without evidence are capped, confidence halved at most, and the risk is recorded."""
    bare = (F.size("evidence_ids") == 0) & (F.col("score") > limit)
    return evaluations.withColumns(
        {
            "score": F.when(bare, F.least("score", F.lit(limit))).otherwise(F.col("score")),
            "confidence": F.when(bare, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")),
            "risks": F.when(bare, F.array_union("risks", F.array(F.lit("high_score_without_evidence")))).otherwise(
                F.col("risks")
            ),
        }
    )


def ordered_distinct(values: Column, position: Column) -> Column:
    """Aggregate: distinct values by the first position that each has."""
    firsts = F.array_sort(F.collect_list(F.struct(position.alias("p"), values.alias("v"))))
    return F.array_distinct(F.transform(firsts, lambda s: s["v"]))


def aggregate_evaluations(evaluations: DataFrame, criteria: list[str], digits: int = 4) -> DataFrame:
    """One row a candidate: mean score of each criterion, their mean, mean confidence, missing criteria."""
    each = evaluations.groupBy("candidate_id", "criterion").agg(
        F.avg("score").alias("mean"), F.sum("confidence").alias("c"), F.count("confidence").alias("n")
    )
    grouped = each.groupBy("candidate_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("criterion", F.round("mean", digits).alias("s"))))).alias(
            "criterion_scores"
        ),
        F.round(F.avg(F.round("mean", digits).cast(f"decimal(12,{digits})")), digits).cast("double").alias("composite"),
        F.round(F.sum("c") / F.nullif(F.sum("n"), F.lit(0)), digits).alias("confidence"),
        F.array_sort(F.collect_set("criterion")).alias("observed"),
    )
    wanted = F.array(*[F.lit(c) for c in sorted(criteria)])
    return grouped.withColumn("missing_criteria", F.array_except(wanted, "observed")).drop("observed")


def weighted_score(scores: Column, weights: Mapping[str, float]) -> Column:
    """Sum of score times weight, exact in decimals; a missing criterion counts 0."""
    total = F.lit(Decimal(0))
    for criterion, weight in weights.items():
        score = F.coalesce(F.try_element_at(scores, F.lit(criterion)), F.lit(0.0)).cast("decimal(12,4)")
        total = total + score * F.lit(Decimal(str(weight)))
    return F.round(total, 4).cast("double")


def penalties(
    config: RankingConfig,
    risks: Column,
    text: Column,
    evidence: Column,
    confidence: Column,
    missing: Column,
    unofficial: Column,
    broad_markers: list[str],
    foreign_markers: list[str],
    policy_markers: list[str],
) -> Column:
    """Array of (code, amount) of the penalties that apply."""
    amounts = config.penalties
    rules = [
        ("direct_duplicate", F.array_contains(risks, "direct_duplicate_detected"), F.lit(1)),
        (
            "official_material_missing",
            F.arrays_overlap(risks, F.array(F.lit("official_material_missing"), F.lit("insufficient_official_evidence")))
            | unofficial,
            F.lit(1),
        ),
        ("scope_too_broad", F.array_contains(risks, "scope_too_broad") | X.contains_any(text, broad_markers), F.lit(1)),
        (
            "foreign_case_only",
            F.array_contains(risks, "foreign_case_only")
            | (X.contains_any(text, foreign_markers) & ~X.contains_any(text, policy_markers)),
            F.lit(1),
        ),
        ("insufficient_evidence_ids", F.size(F.array_distinct(evidence)) < config.minimum_evidence, F.lit(1)),
        ("low_confidence", confidence.isNull() | (confidence < config.low_confidence), F.lit(1)),
        ("missing_criterion", missing > 0, missing),
    ]
    each = [
        F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(amounts[code]) * times).cast("double").alias("amount")))
        for code, when, times in rules
    ]
    return F.filter(F.array(*each), lambda p: p.isNotNull() & (p["amount"] > 0))


def total_amount(adjustments: Column) -> Column:
    return F.aggregate(adjustments, F.lit(0.0), lambda a, p: a + p["amount"])


def penalised(raw: Column, adjustments: Column) -> Column:
    return F.greatest(F.lit(0.0), F.round(raw - total_amount(adjustments), 4))


_DIVERSE = "run string, candidate_id string, rank int, penalized_score double, adjusted_score double, deducted double"


class _Alike:
    """Candidates of a run whose attributes are the same, and so their deduction: the best of them for any deduction."""

    def __init__(self, rows: list) -> None:
        self.ids = sorted(r.candidate_id for r in rows)[::-1]
        # No score counts as the least.
        score = lambda r: r.penalized_score if r.penalized_score == r.penalized_score else float("-inf")
        groups: dict[float, list] = {}
        for r in sorted(rows, key=lambda r: r.candidate_id, reverse=True):
            groups.setdefault(score(r), []).append(r.candidate_id)
        self.groups = sorted(groups.items())

    def best(self, cut: float, left: dict) -> tuple | None:
        """(-score, id) of the best one that is ``left``, ties by id; none if all are gone."""
        groups = self.groups
        while groups and not self._open(groups[-1][1], left):
            groups.pop()
        if not groups:
            return None
        found = round(max(0.0, groups[-1][0] - cut), 4)
        if found == 0:  # of all others, too
            return (-found, self._open(self.ids, left)[-1])
        ids = []
        for score, held in reversed(groups):
            if round(max(0.0, score - cut), 4) != found:
                break
            ids += self._open(held, left)[-1:]
        return (-found, min(ids))

    @staticmethod
    def _open(ids: list, left: dict) -> list:
        while ids and ids[-1] not in left:
            ids.pop()
        return ids


def diversify(ranked: DataFrame, repeats: Mapping[str, float] = REPEATS, limit: int | None = None) -> DataFrame:
    """Greedy selection: each time the candidate of the best score after deductions for attributes already chosen, ties
    by id. Every choice depends on those before it; a run's candidates, which its generator bounds, are one group. A choice
    looks at the best of each combination of attributes, not at all candidates.

    ``ranked`` has (run, candidate_id, penalized_score, domain, country, output, horizon); null attributes do not count.
    """

    def select(rows: pd.DataFrame) -> pd.DataFrame:
        left = {r.candidate_id: r for r in rows.itertuples(index=False)}
        alike: dict[tuple, list] = {}
        for r in left.values():
            alike.setdefault(tuple(v if isinstance(v := getattr(r, k), str) else None for k in repeats), []).append(r)
        kinds = {values: _Alike(held) for values, held in alike.items()}
        seen: dict[tuple[str, str], int] = {}
        out = []
        while left and (limit is None or len(out) < limit):
            best = None
            for values, kind in list(kinds.items()):
                cut = sum(seen.get((k, v), 0) * amount for (k, amount), v in zip(repeats.items(), values, strict=True))
                key = kind.best(cut, left)
                if key is None:
                    del kinds[values]
                elif best is None or key < best[0]:
                    best = (key, values, cut)
            key, values, cut = best
            r = left.pop(key[1])
            out.append((r.run, r.candidate_id, len(out) + 1, r.penalized_score, -key[0], float(cut)))
            for k, value in zip(repeats, values, strict=True):
                if value is not None:
                    seen[k, value] = seen.get((k, value), 0) + 1
        return pd.DataFrame(out, columns=["run", "candidate_id", "rank", "penalized_score", "adjusted_score", "deducted"])

    return ranked.groupBy("run").applyInPandas(select, _DIVERSE)


def ratio_metric(section: str, metric: str, numerator: Column, denominator: Column) -> Column:
    """Struct of a named ratio. A zero denominator leaves it unavailable, with a reason, never zero."""
    n, d = numerator.cast("long"), denominator.cast("long")
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(metric).alias("metric"),
        n.alias("numerator"),
        d.alias("denominator"),
        F.round(F.when(d > 0, n / d), 6).alias("value"),
        F.when(d > 0, "available").otherwise("unavailable").alias("status"),
        F.when(d > 0, F.lit(None).cast("string")).otherwise("zero_denominator").alias("reason"),
    )


def unknown_ids(candidates: DataFrame, id_col: str, ids: str, known: DataFrame, known_id: str) -> DataFrame:
    """Rows (id_col, unknown_id): array members that the known table lacks."""
    each = candidates.select(id_col, F.explode(ids).alias("unknown_id")).distinct()
    return each.join(known.select(F.col(known_id).alias("unknown_id")).distinct(), "unknown_id", "left_anti").select(
        id_col, "unknown_id"
    )


def attach_in_order(rows: DataFrame, id_col: str, ids: str, known: DataFrame, known_id: str, value: str, out: str) -> DataFrame:
    """Values of the known members of an id array, in the array's order; unknown ones are left out."""
    each = rows.select(id_col, F.posexplode(ids).alias("__pos", "__key"))
    joined = each.join(known.select(F.col(known_id).alias("__key"), F.col(value).alias("__value")), "__key")
    lists = joined.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("__pos", "__value"))).alias("__l"))
    return lists.select(id_col, F.transform("__l", lambda s: s["__value"]).alias(out))
