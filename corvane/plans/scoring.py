"""Evaluation, ranking, review and metric queries; events stand in for evaluations and review logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions import text as X
from corvane.operators import candidates as near
from corvane.operators import golden as Q
from corvane.operators import issues
from corvane.operators import review as R
from corvane.operators import scoring as S
from corvane.plans.catalogue import register
from corvane.sources.tables import spread, table

CRITERIA = sorted(S.WEIGHTS)
#: Criterion of an event: by its id, so that each candidate misses some.
_CRIT = "['feasibility', 'novelty', 'output_fit', 'policy_impact', 'policy_relevance', 'public_evidence_sufficiency', 'timeliness'][(event_id % 7 + 1)::INT]"
_EVAL = f"""evaluations AS (SELECT event_id, user_id % 50 AS run, user_id AS candidate_id, {_CRIT} AS criterion,
  least(100.0::DOUBLE, greatest(0.0::DOUBLE, value * 0.7310585::DOUBLE)) AS score, (event_id % 997) / 997.0::DOUBLE AS confidence, event_id % 3 AS n_evidence FROM events WHERE event_id % 7 <= user_id % 8)"""
_GATED = f"""{_EVAL}, gated AS (SELECT * REPLACE (CASE WHEN n_evidence = 0 AND score > 60 THEN 60.0::DOUBLE ELSE score END AS score,
  CASE WHEN n_evidence = 0 AND score > 60 THEN least(confidence, 0.5::DOUBLE) ELSE confidence END AS confidence), n_evidence = 0 AND score > 60 AS capped FROM evaluations)"""
_AGG = f"""{_GATED}, each AS (SELECT run, candidate_id, criterion, round(avg(score), 4) AS s, sum(confidence) AS c, count(confidence) AS n FROM gated GROUP BY ALL),
agg AS (SELECT run, candidate_id, ((2 * sum((s * 10000)::BIGINT) + count(*)) // (2 * count(*)))::DOUBLE / 10000 AS composite, round(sum(c) / sum(n), 4) AS confidence, 7 - count(*) AS missing,
  sum(s::DECIMAL(12,4) * CASE criterion WHEN 'policy_relevance' THEN 0.20 WHEN 'novelty' THEN 0.20 WHEN 'public_evidence_sufficiency' THEN 0.15 WHEN 'policy_impact' THEN 0.15 ELSE 0.10 END) AS raw FROM each GROUP BY ALL)"""


def _evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    criterion = F.array(*[F.lit(c) for c in CRITERIA])[(F.col("event_id") % 7).cast("int")]
    rows = table(spark, sf_dir, "events").filter("event_id % 7 <= user_id % 8")
    return rows.select(
        "event_id",
        F.col("user_id").alias("candidate_id"),
        criterion.alias("criterion"),
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value") * 0.7310585)).alias("score"),
        ((F.col("event_id") % 997) / 997.0).alias("confidence"),
        F.slice(F.array(F.lit("e1"), F.lit("e2")), F.lit(1), (F.col("event_id") % 3).cast("int")).alias("evidence_ids"),
        F.array().cast("array<string>").alias("risks"),
    )


@register("eval_evidence_gate", f"WITH {_GATED} SELECT event_id, round(score, 6) AS score, round(confidence, 6) AS confidence, capped FROM gated")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = S.evidence_gate(_evaluations(spark, sf_dir))
    capped = F.array_contains("risks", "high_score_without_evidence")
    return gated.select("event_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), capped.alias("capped"))


@register("eval_aggregate", f"WITH {_AGG} SELECT candidate_id, composite, confidence, missing::INT AS missing FROM agg")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.aggregate_evaluations(S.evidence_gate(_evaluations(spark, sf_dir)), CRITERIA)
    return found.select(
        "candidate_id",
        "composite",
        "confidence",
        F.size("missing_criteria").alias("missing"),
    )


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.aggregate_evaluations(S.evidence_gate(_evaluations(spark, sf_dir)), CRITERIA)
    k = F.col("candidate_id")
    risks = F.filter(
        F.array(F.when(k % 9 == 0, "direct_duplicate_detected"), F.when(k % 10 == 0, "scope_too_broad")), lambda r: r.isNotNull()
    )
    evidence = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.lit(1), (k % 4).cast("int"))
    title = F.when(k % 11 == 0, "all of it").when(k % 13 == 0, "foreign case").otherwise("study")
    rules = S.penalties(
        S.RankingConfig(),
        risks,
        title,
        evidence,
        F.col("confidence"),
        F.size("missing_criteria"),
        k % 6 == 0,
        ["all of it"],
        ["foreign case"],
        ["policy"],
    )
    scored = found.withColumn("raw", S.weighted_score(F.col("criterion_scores"), S.WEIGHTS)).withColumn("penalties", rules)
    return scored.withColumn("penalized", S.penalised(F.col("raw"), F.col("penalties")))


_PENALISED = f"""{_AGG}, scored AS (SELECT run, candidate_id, round(raw, 4)::DOUBLE AS raw, missing,
  CASE WHEN candidate_id % 9 = 0 THEN 20 ELSE 0 END + CASE WHEN candidate_id % 6 = 0 THEN 12 ELSE 0 END + CASE WHEN candidate_id % 10 = 0 OR candidate_id % 11 = 0 THEN 8 ELSE 0 END
  + CASE WHEN candidate_id % 13 = 0 AND candidate_id % 11 <> 0 THEN 6 ELSE 0 END + CASE WHEN candidate_id % 4 < 2 THEN 10 ELSE 0 END
  + CASE WHEN confidence < 0.5 THEN 8 ELSE 0 END + 5 * missing AS deducted FROM agg),
penalised AS (SELECT *, greatest(0.0::DOUBLE, round(raw - deducted, 4)) AS penalized FROM scored)"""


@register(
    "score_weighted_penalised",
    f"WITH {_PENALISED} SELECT candidate_id, raw, deducted::DOUBLE AS deducted, penalized FROM penalised",
)
def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select(
        "candidate_id",
        "raw",
        S.total_amount(F.col("penalties")).alias("deducted"),
        "penalized",
    )


@register("score_diversified")
def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of candidates, each diversified by itself."""
    k = F.col("candidate_id")
    ranked = _ranked(spark, sf_dir).select(
        (k % 50).cast("string").alias("run"),
        F.lpad(k.cast("string"), 12, "0").alias("candidate_id"),
        F.col("penalized").alias("penalized_score"),
        F.concat(F.lit("d"), k % 3).alias("domain"),
        F.when(k % 4 != 0, F.concat(F.lit("c"), k % 2)).alias("country"),
        F.concat(F.lit("o"), k % 2).alias("output"),
        F.when(k % 5 != 0, "short").alias("horizon"),
    )
    return S.diversify(ranked)


@register(
    "candidate_grounding_violations",
    """SELECT DISTINCT l_orderkey // 1000 AS candidate, l_orderkey + 7 AS unknown_id FROM lineitem
WHERE l_orderkey + 7 NOT IN (SELECT o_orderkey FROM orders)""",
)
def grounding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).alias("candidate"), F.array(F.col("l_orderkey") + 7).alias("ids")
    )
    return S.unknown_ids(lines, "candidate", "ids", table(spark, sf_dir, "orders"), "o_orderkey")


@register(
    "attach_in_order",
    """SELECT o_orderkey, array_to_string([c1.c_name, c2.c_name], ',') AS names FROM orders
JOIN customer c1 ON c1.c_custkey = o_custkey JOIN customer c2 ON c2.c_custkey = 1""",
)
def attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_custkey"), F.lit(1), F.lit(-5)).alias("ids"))
    found = S.attach_in_order(orders, "o_orderkey", "ids", table(spark, sf_dir, "customer"), "c_custkey", "c_name", "names")
    return found.select("o_orderkey", F.array_join("names", ",").alias("names"))


@register(
    "candidate_near_duplicates_exact",
    """SELECT regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') AS title, min(p_partkey) AS first_key, (count(*) - 1)::BIGINT AS later FROM part GROUP BY 1 HAVING count(*) > 1""",
)
def near_duplicates_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = table(spark, sf_dir, "part").groupBy(X.canonical_text(F.col("p_name")).alias("title"))
    return titles.agg(F.min("p_partkey").alias("first_key"), (F.count("*") - 1).alias("later")).filter("later > 0")


@register("candidate_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates, in order of their key: title and question both near those of one kept before."""
    question = F.concat_ws(" ", "p_type", "p_brand", "p_size", "p_retailprice")
    parts = table(spark, sf_dir, "part").withColumn("question", question).withColumn("place", F.lit(0))
    return near.drop_near_duplicates(parts, "p_partkey", "p_name", "question", ["place"])


_DECISION = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'hold' ELSE 'reject' END"
_LOG = f"log AS (SELECT user_id % 20 AS run, user_id AS candidate_id, event_id, ts, {_DECISION} AS decision FROM events WHERE user_id % 9 <> 0)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    decision = F.when(kind == "purchase", "approve").when(kind == "click", "hold").otherwise("reject")
    return table(spark, sf_dir, "events").filter("user_id % 9 <> 0").select(
        (F.col("user_id") % 20).alias("run"), F.col("user_id").alias("candidate_id"), "event_id", "ts", decision.alias("decision")
    )


@register(
    "review_latest_decision",
    f"WITH {_LOG} SELECT run, candidate_id, arg_max(decision, (ts, event_id)) AS decision, arg_max(event_id, (ts, event_id)) AS event_id FROM log GROUP BY ALL",
)
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_decision(_log(spark, sf_dir), ["run", "candidate_id"], ["ts", "event_id"], ["decision", "event_id"])


@register(
    "review_gate_status",
    f"""WITH {_LOG}, latest AS (SELECT run, candidate_id, arg_max(decision, (ts, event_id)) AS decision FROM log GROUP BY ALL),
c AS (SELECT DISTINCT user_id % 20 AS run, user_id AS candidate_id FROM events)
SELECT c.run, count(*)::BIGINT AS candidates, count(*) FILTER (WHERE decision IS NULL)::BIGINT AS pending, count(*) FILTER (WHERE decision = 'approve')::BIGINT AS approved,
  CASE WHEN count(*) FILTER (WHERE decision IS NULL) > 0 THEN 'awaiting_review' WHEN count(*) FILTER (WHERE decision = 'approve') > 0 THEN 'ready' ELSE 'completed' END AS status
FROM c LEFT JOIN latest l ON c.run = l.run AND c.candidate_id = l.candidate_id GROUP BY c.run""",
)
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.col("user_id").alias("candidate_id")).distinct()
    return R.gate_status(candidates, latest(spark, sf_dir).drop("event_id"), "run", ["run", "candidate_id"], undecided=())


@register(
    "review_gate_cards",
    f"""WITH log AS (SELECT user_id % 20 AS run, user_id AS candidate_id, event_id, ts, {_DECISION} AS decision FROM events),
latest AS (SELECT run, candidate_id, arg_max(decision, (ts, event_id)) AS decision FROM log GROUP BY ALL),
gate AS (SELECT run, CASE WHEN count(*) FILTER (WHERE decision = 'hold') > 0 THEN 'awaiting_review' WHEN count(*) FILTER (WHERE decision = 'approve') > 0 THEN 'ready' ELSE 'completed' END AS status,
  count(*)::BIGINT AS candidates, count(*) FILTER (WHERE decision = 'hold')::BIGINT AS pending, count(*) FILTER (WHERE decision = 'approve')::BIGINT AS approved FROM latest GROUP BY run)
SELECT gate.*, CASE WHEN status = 'ready' THEN approved ELSE 0 END::BIGINT AS cards FROM gate""",
)
def gate_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of every run over all events, a decision on hold being none, and the cards that it lets through."""
    kind = F.col("event_type")
    decision = F.when(kind == "purchase", "approve").when(kind == "click", "hold").otherwise("reject")
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.col("user_id").alias("candidate_id"), "event_id", "ts", decision.alias("decision"))
    decided = R.latest_decision(log, ["run", "candidate_id"], ["ts", "event_id"], ["decision"])
    status = R.gate_status(decided.select("run", "candidate_id"), decided, "run", ["run", "candidate_id"])
    approved = decided.filter("decision = 'approve'").select("run", "candidate_id", F.lit("report").alias("output_type"), F.array(F.col("candidate_id")).alias("evidence"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("publication").alias("kind"))
    cards = issues.planning_cards(approved, known, {}, status).groupBy("run").agg(F.count("*").alias("cards"))
    return status.join(cards, "run", "left").withColumn("cards", F.coalesce("cards", F.lit(0)))


@register(
    "review_log_integrity",
    f"""WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY event_id) AS k, lag(ts) OVER (PARTITION BY candidate_id ORDER BY event_id) AS before FROM log)
SELECT candidate_id, count(*) FILTER (WHERE event_id <> k)::BIGINT AS gaps, count(*) FILTER (WHERE ts < before)::BIGINT AS backwards, (count(*) - count(DISTINCT event_id))::BIGINT AS repeated_ids FROM n GROUP BY candidate_id""",
)
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.log_faults(_log(spark, sf_dir), "candidate_id", "event_id", "ts", "event_id")


@register(
    "review_apply_edits",
    "SELECT d.doc_id, coalesce('q' || quality, source) AS source, lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    edits = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality")).alias("title"))
    return R.overlay(base, edits, "doc_id", {"source": "title"})


_STATES = "['queued', 'running', 'awaiting_human_review', 'approved', 'held', 'failed']"


@register(
    "lifecycle_transitions",
    f"""WITH h AS (SELECT o_custkey AS project, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, {_STATES}[(o_orderkey % 6 + 1)::INT] AS s FROM orders),
t AS (SELECT project, revision, lag(s) OVER (PARTITION BY project ORDER BY revision) AS from_status, s AS to_status FROM h)
SELECT * FROM t WHERE NOT (from_status IS NULL AND to_status = 'queued') AND coalesce((from_status, to_status) NOT IN (('queued', 'running'), ('queued', 'failed'),
  ('running', 'awaiting_human_review'), ('running', 'failed'), ('awaiting_human_review', 'approved'), ('awaiting_human_review', 'rejected'), ('awaiting_human_review', 'held')), TRUE)""",
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(*[F.lit(s) for s in ("queued", "running", "awaiting_human_review", "approved", "held", "failed")])
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    history = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project"),
        F.row_number().over(order).cast("long").alias("revision"),
        states[(F.col("o_orderkey") % 6).cast("int")].alias("status"),
    )
    return R.transition_faults(history, "project", "revision", "status")


@register(
    "ratio_metrics",
    """WITH j AS (SELECT d.doc_id, text, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT 'corpus' AS section, 'labelled_rate' AS metric, count(quality) AS numerator, count(*) AS denominator FROM j
  UNION ALL SELECT 'corpus', 'good_rate', count(*) FILTER (WHERE quality = 1), count(quality) FROM j
  UNION ALL SELECT 'corpus', 'toxic_rate', count(*) FILTER (WHERE toxic = 1), count(toxic) FROM j
  UNION ALL SELECT 'corpus', 'duplicate_rate', count(*) - count(DISTINCT text), count(*) FROM j
  UNION ALL SELECT 'golden', 'recall_at_k', 0, 0)
SELECT section, metric, numerator::BIGINT AS numerator, denominator::BIGINT AS denominator, round(CASE WHEN denominator > 0 THEN numerator::DOUBLE / denominator END, 6) AS value,
  CASE WHEN denominator > 0 THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN denominator = 0 THEN 'zero_denominator' END AS reason FROM m""",
)
def ratio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sums = joined.agg(
        F.count("*").alias("n"),
        F.count("quality").alias("labelled"),
        F.count_if(F.col("quality") == 1).alias("good"),
        F.count("toxic").alias("judged"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_distinct(F.sha2("text", 256)).alias("kinds"),
    )
    c = F.col
    metrics = F.array(
        S.ratio_metric("corpus", "labelled_rate", c("labelled"), c("n")),
        S.ratio_metric("corpus", "good_rate", c("good"), c("labelled")),
        S.ratio_metric("corpus", "toxic_rate", c("toxic"), c("judged")),
        S.ratio_metric("corpus", "duplicate_rate", c("n") - c("kinds"), c("n")),
        S.ratio_metric("golden", "recall_at_k", F.lit(0), F.lit(0)),
    )
    return sums.select(F.inline(metrics))


_TOK = "list_distinct(list_filter(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[0-9a-z]+|[가-힣]+'), lambda t: length(t) >= 2))"


@register(
    "golden_jaccard_neardup",
    f"""WITH s AS (SELECT doc_id, {_TOK.format("split_part(text, chr(10), 1)")} AS t FROM documents), k AS (SELECT * FROM s WHERE len(t) > 0)
SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM k a JOIN k b ON a.doc_id < b.doc_id
WHERE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) >= 0.7""",
)
def golden_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = spread(table(spark, sf_dir, "documents")).select("doc_id", X.content_tokens(F.split_part("text", F.lit("\n"), F.lit(1))).alias("tokens"))
    return Q.jaccard_pairs(heads, "doc_id", "tokens", 0.7).withColumn("jaccard", F.round("jaccard", 6))


@register(
    "golden_page_proposal",
    f"""WITH q AS (SELECT item_id, unnest({_TOK.format('text')}) AS token FROM benchmark), d AS (SELECT doc_id, length(text) AS size, unnest({_TOK.format('text')}) AS token FROM documents),
h AS (SELECT item_id AS question, doc_id AS page, size, count(*) AS hits FROM d JOIN q ON d.token = q.token GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY hits DESC, size DESC, page) AS place FROM h)
SELECT question, page, hits, place::INT AS place FROM r WHERE place <= 3""",
)
def golden_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), X.content_tokens(F.col("text")).alias("tokens"))
    pages = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("page"), F.length("text").alias("size"), X.content_tokens(F.col("text")).alias("tokens")
    )
    return Q.page_proposals(questions, pages, 3).select("question", "page", "hits", "place")


@register(
    "golden_grounding",
    f"""WITH q AS (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark), d AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents WHERE doc_id = 0)
SELECT item_id, round(CASE WHEN len(q.t) > 0 THEN len(list_intersect(q.t, d.t))::DOUBLE / len(q.t) END, 6) AS grounding, coalesce(len(list_intersect(q.t, d.t))::DOUBLE / nullif(len(q.t), 0), 0) < 0.5 AS low_grounding FROM q, d""",
)
def golden_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each question's tokens that one mapped document holds."""
    questions = table(spark, sf_dir, "benchmark").select("item_id", X.content_tokens(F.col("text")).alias("t"), F.lit(0).cast("long").alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", X.content_tokens(F.col("text")).alias("d"))
    share = F.when(F.size("t") > 0, F.size(F.array_intersect("t", "d")) / F.size("t"))
    found = questions.join(docs, "doc_id")
    return found.select(
        "item_id", F.round(share, 6).alias("grounding"), (F.coalesce(share, F.lit(0.0)) < 0.5).alias("low_grounding")
    )


@register(
    "golden_leak",
    f"""WITH q AS (SELECT item_id, {_TOK.format("split_part(text, '.', 1)")} AS ask, {_TOK.format("split_part(text, '.', 2)")} AS answer FROM benchmark)
SELECT item_id, round(CASE WHEN len(answer) > 0 THEN len(list_intersect(answer, ask))::DOUBLE / len(answer) END, 6) AS leak, coalesce(len(list_intersect(answer, ask))::DOUBLE / nullif(len(answer), 0), 0) > 0.5 AS answer_leak FROM q""",
)
def golden_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: X.content_tokens(F.split_part("text", F.lit("."), F.lit(n)))
    rows = table(spark, sf_dir, "benchmark").select("item_id", part(1).alias("ask"), part(2).alias("answer"))
    share = F.when(F.size("answer") > 0, F.size(F.array_intersect("answer", "ask")) / F.size("answer"))
    return rows.select("item_id", F.round(share, 6).alias("leak"), (F.coalesce(share, F.lit(0.0)) > 0.5).alias("answer_leak"))


@register(
    "golden_label_map",
    """WITH n AS (SELECT DISTINCT p_name AS name, regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') AS n FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 9) ELSE p_name END AS label FROM part),
l AS (SELECT label, regexp_replace(lower(label), '[^0-9a-z]+', '', 'g') AS l FROM a),
e AS (SELECT label, min(name) AS name FROM l JOIN n ON l = n GROUP BY label),
p AS (SELECT label, min(name) AS name, count(DISTINCT n) AS k FROM l JOIN n ON (starts_with(n, l) OR starts_with(l, n)) AND length(l) >= 3 AND length(n) >= 3 WHERE label NOT IN (SELECT label FROM e) GROUP BY label)
SELECT l.label, CASE WHEN e.label IS NOT NULL THEN e.name WHEN k = 1 THEN p.name END AS name,
  CASE WHEN e.label IS NOT NULL THEN 'exact' WHEN k = 1 THEN 'prefix' WHEN k > 1 THEN 'ambiguous' ELSE 'unmapped' END AS how FROM l LEFT JOIN e ON l.label = e.label LEFT JOIN p ON l.label = p.label""",
)
def golden_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    short = F.when(F.col("p_partkey") % 3 == 0, F.substring("p_name", 1, 9)).otherwise(F.col("p_name"))
    return Q.map_labels(parts.select(short.alias("label")), parts.filter("p_partkey % 2 = 0"), "label", "p_name")
