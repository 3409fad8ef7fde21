"""Queries of the metric suite; whole tables stand in for a pilot run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import metrics as M
from corvane.plans.catalogue import register
from corvane.sources.tables import table

#: The last two columns of every oracle; ``why`` is the reason where the denominator is zero or null.
_SHOWN = """SELECT section, metric, numerator::BIGINT AS numerator, denominator::BIGINT AS denominator,
  round(CASE WHEN denominator > 0 THEN numerator::DOUBLE / denominator END, 6) AS value,
  CASE WHEN denominator > 0 THEN 'available' ELSE 'unavailable' END AS status,
  CASE WHEN denominator > 0 THEN NULL ELSE why END AS reason FROM m"""


@register(
    "metrics_data",
    f"""WITH f AS (SELECT coalesce(trim(text) <> '', FALSE) AS ok, (lang IS NULL)::INT + (source IS NULL)::INT + (quality IS NULL)::INT AS missing
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE ok) AS k, coalesce(sum(missing) FILTER (WHERE ok), 0) AS missing FROM f),
m AS (SELECT 'data' AS section, 'processing_success_rate' AS metric, k AS numerator, n AS denominator, 'zero_denominator' AS why FROM s
  UNION ALL SELECT 'data', 'publication_type_classification_accuracy', NULL, NULL, 'no_reviewed_types'
  UNION ALL SELECT 'data', 'essential_metadata_missing_rate', missing, 3 * k, 'zero_denominator' FROM s) {_SHOWN}""",
)
def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    files = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    readable = F.coalesce(F.trim("text") != "", F.lit(False))
    return M.data_metrics(files, readable, [F.col("lang"), F.col("source"), F.col("quality")])


@register(
    "metrics_search",
    f"""WITH r AS (SELECT user_id AS query, CASE WHEN user_id % 2 = 0 THEN 'click' END AS wanted, event_id // 2 AS id, event_type AS type FROM events),
s AS (SELECT count(wanted) AS typed, count(*) FILTER (WHERE wanted = type) AS fit, count(*) FILTER (WHERE wanted IS NULL) AS free,
  count(DISTINCT (query, id)) FILTER (WHERE wanted IS NULL) AS kinds FROM r),
m AS (SELECT 'search' AS section, 'recall_at_k' AS metric, NULL AS numerator, NULL AS denominator, 'no_reviewed_queries' AS why
  UNION ALL SELECT 'search', 'publication_type_filter_accuracy', fit, typed, 'zero_denominator' FROM s
  UNION ALL SELECT 'search', 'result_duplicate_rate', free - kinds, free, 'zero_denominator' FROM s) {_SHOWN}""",
)
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("query"),
        F.when(F.col("user_id") % 2 == 0, "click").alias("wanted_type"),
        F.floor(F.col("event_id") / 2).alias("publication_id"),
        F.col("event_type").alias("publication_type"),
    )
    return M.search_metrics(results)


@register(
    "metrics_generation",
    f"""WITH c AS (SELECT regexp_replace(lower(p_name), '[^0-9a-z가-힣]+', '', 'g') AS title, regexp_replace(lower(p_brand), '[^0-9a-z가-힣]+', '', 'g') AS question,
  p_size % 3 > 0 AS signal, p_partkey % 4 > 0 AS publication FROM part),
g AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^0-9a-z가-힣]+', '', 'g') AS title FROM part JOIN supplier ON p_partkey = s_suppkey),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE signal OR publication) AS grounded, count(DISTINCT (title, question)) AS kinds,
  count(*) FILTER (WHERE title IN (SELECT title FROM g)) AS news, count(*) FILTER (WHERE publication) AS linked FROM c),
m AS (SELECT 'generation' AS section, 'evidence_id_inclusion_rate' AS metric, grounded AS numerator, n AS denominator, 'zero_denominator' AS why FROM s
  UNION ALL SELECT 'generation', 'duplicate_candidate_rate', n - kinds, n, 'zero_denominator' FROM s
  UNION ALL SELECT 'generation', 'simple_news_title_rate', news, n, 'zero_denominator' FROM s
  UNION ALL SELECT 'generation', 'internal_publication_link_rate', linked, n, 'zero_denominator' FROM s) {_SHOWN}""",
)
def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    some = lambda n: F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), n.cast("int"))
    candidates = part.select(
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("question"),
        some(F.col("p_size") % 3).alias("signal_ids"),
        some(F.col("p_partkey") % 4).alias("publication_ids"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"))
    return M.generation_metrics(candidates, part.join(suppliers, "p_partkey").select(F.col("p_name").alias("title")))


@register(
    "metrics_evaluation",
    f"""WITH e AS (SELECT user_id, count(DISTINCT event_id % 7) FILTER (WHERE event_type <> 'error') AS results, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY user_id),
s AS (SELECT sum(results) AS r, sum(failures) AS f, sum(7 - results) AS missing, count(*) FILTER (WHERE failures > 0) AS failed,
  count(*) FILTER (WHERE failures > 0 AND results > 0) AS recovered FROM e),
m AS (SELECT 'evaluation' AS section, 'direct_duplicate_detection_accuracy' AS metric, NULL AS numerator, NULL AS denominator, 'no_reviewed_duplicates' AS why
  UNION ALL SELECT 'evaluation', 'official_material_gap_detection_accuracy', NULL, NULL, 'no_reviewed_gaps'
  UNION ALL SELECT 'evaluation', 'schema_success_rate', r, r + f, 'zero_denominator' FROM s
  UNION ALL SELECT 'evaluation', 'criterion_coverage_rate', r, r + missing, 'zero_denominator' FROM s
  UNION ALL SELECT 'orchestration', 'partial_failure_recovery_rate', recovered, failed, 'no_partial_failure' FROM s) {_SHOWN}""",
)
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_distinct(F.when(~error, F.col("event_id") % 7)).alias("results"), F.count_if(error).alias("failures")
    )
    return M.evaluation_metrics(each.withColumn("missing", 7 - F.col("results")))


@register(
    "metrics_orchestration",
    f"""WITH n AS (SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS tried, count(*) FILTER (WHERE o_orderstatus = 'F') AS k FROM orders),
a AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS retries, max(event_id)::BIGINT + 1 = count(*) AS same FROM events),
m AS (SELECT 'orchestration' AS section, 'node_success_rate' AS metric, k AS numerator, tried AS denominator, 'no_node_states' AS why FROM n
  UNION ALL SELECT 'orchestration', 'retry_count', retries, 1, 'no_retry_record' FROM a
  UNION ALL SELECT 'orchestration', 'interrupt_resume', NULL, NULL, 'not_resumed_yet'
  UNION ALL SELECT 'orchestration', 'reproducibility', same::BIGINT, 1, 'no_second_run' FROM a) {_SHOWN}""",
)
def orchestration(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", M.NODE_NOT_RUN).otherwise("failed")
    nodes = table(spark, sf_dir, "orders").select(state.alias("status"))
    audit = table(spark, sf_dir, "events").agg(
        F.count_if(F.col("event_type") == "error").alias("retry_count"),
        F.lit(None).cast("boolean").alias("resumed"),
        (F.max("event_id") + 1 == F.count("*")).alias("reproduced"),
    )
    return M.audit_metrics(nodes, audit)


@register(
    "metrics_expert",
    f"""WITH t AS (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 3 > 0) AS evidence, count(*) FILTER (WHERE c_custkey % 2 > 0 AND length(c_mktsegment) > 0) AS trace FROM t),
m AS (SELECT 'expert' AS section, 'top_five_evidence_coverage' AS metric, evidence AS numerator, n AS denominator, 'zero_denominator' AS why FROM s
  UNION ALL SELECT 'expert', 'top_five_score_trace_coverage', trace, n, 'zero_denominator' FROM s) {_SHOWN}""",
)
def expert(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n: F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), n.cast("int"))
    ranked = table(spark, sf_dir, "customer").select(
        F.struct((-F.col("c_acctbal")).alias("score"), "c_custkey").alias("rank"),
        some(F.col("c_custkey") % 3).alias("evidence_ids"),
        some(F.col("c_custkey") % 2).alias("criterion_scores"),
        F.col("c_mktsegment").alias("explanation"),
    )
    return M.expert_metrics(ranked)
