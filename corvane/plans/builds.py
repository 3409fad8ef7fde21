"""Queries over stored artifacts: verified tables, corpus builds and the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import build as B
from corvane import vector_index as V
from corvane.operators import corpus as C
from corvane.plans.catalogue import register
from corvane.plans.corpus import _FOLD
from corvane.sources import verified
from corvane.sources.tables import spread, table
from corvane.storage import scratch_path
from corvane.streaming import review_state as R


@register(
    "verified_read",
    "SELECT o_orderstatus, count(*)::BIGINT AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1",
)
def verified_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored with a manifest, read back in one verified scan and added up; what is returned was published after the
    comparison."""
    root, out = scratch_path(spark, "orders"), scratch_path(spark, "orders-by-status")
    verified.write_verified(table(spark, sf_dir, "orders"), root)
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")
    last = F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last")
    version = verified.read_verified(spark, root).write(out, lambda rows: rows.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), total, last))
    return spark.read.parquet(version.path)


SETTINGS = B.Settings(C.Thresholds(min_characters=300, min_hangul_ratio=0.0, min_filled_pages=0.5), 1500)
_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def _sources(spark: SparkSession, sf_dir: str, changed: bool) -> DataFrame:
    """Conversations as documents of pages; with ``changed`` every third has another text."""
    turns = table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    page = F.struct(
        (F.col("turn") + 1 + F.when(F.col("turn") >= 5, 1).otherwise(0)).cast("int").alias("page"),
        F.when(F.col("turn") < 2, "opening").otherwise("rest").alias("section"),
        (F.when(F.col("conv_id") % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text) if changed else text).alias("text"),
    )
    held = turns.groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    return held.withColumn("source_checksum", F.sha2(F.to_json("pages"), 256))


def _parse(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "source_checksum", F.lit(False).alias("orphan"), F.lit(False).alias("risky_name"), "pages")


@register(
    "corpus_build",
    f"""WITH {_FOLD}, bodies AS (SELECT conv_id AS doc, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text, count(*) AS pages,
    count(*) FILTER (WHERE NOT regexp_full_match(coalesce(text, ''), '\\s*')) AS filled FROM conversations GROUP BY 1),
measured AS (SELECT *, length(text) - length(regexp_replace(text, '{_CTRL}', '', 'g')) AS control FROM bodies),
own AS (SELECT *, sha256(text) AS checksum, CASE WHEN length(text) < 300 THEN 'low_text' WHEN control > 0.01 * length(text) THEN 'corrupt_text'
    WHEN filled < 0.5 * pages THEN 'warning' WHEN control > 0 THEN 'warning' ELSE 'ready' END AS own_status FROM measured),
owners AS (SELECT checksum, min(doc) AS owner FROM own WHERE own_status IN ('ready', 'warning') GROUP BY 1),
counted AS (SELECT doc, max(chunk) + 1 AS n FROM fold GROUP BY 1)
SELECT doc, CASE WHEN owner < doc THEN 'duplicate' ELSE own_status END AS status, CASE WHEN owner < doc THEN owner END AS duplicate_of,
  CASE WHEN own_status IN ('ready', 'warning') THEN n ELSE 0 END::BIGINT AS n_chunks, CASE WHEN doc % 3 = 0 THEN 2 ELSE 1 END AS built_by
FROM own JOIN counted USING (doc) LEFT JOIN owners USING (checksum)""",
)
def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds: the second finds every third document changed and makes only these again."""
    root = scratch_path(spark, "corpus")
    B.build_corpus(lambda: _sources(spark, sf_dir, True), _parse, spark, root, SETTINGS)
    made = B.build_corpus(lambda: _sources(spark, sf_dir, False), _parse, spark, root, SETTINGS)
    by = F.when(F.col("part") == made.version.about["part"], 2).otherwise(1)
    return made.documents.select("doc", "status", "duplicate_of", "n_chunks", by.alias("built_by"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk of its source."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.concat(F.lit("chunk:"), "doc_id").alias("chunk_id"),
        F.coalesce("source", F.lit("none")).alias("publication_id"),
        F.col("doc_id").alias("chunk_index"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"),
        F.lit("1").alias("chunking_version"),
        "text",
    )


_AXIS = "(('0x' || substr(sha256({}), 16, 1))::INT % 8)"


@register(
    "vector_index_search",
    f"""WITH indexed AS (SELECT 'chunk:' || doc_id AS chunk_id, coalesce(source, 'none') AS publication_id, doc_id AS chunk_index, sha256(text) AS checksum,
  CASE WHEN {_AXIS.format("text")} = {_AXIS.format("'the policy'")} THEN 1.0 ELSE 0.0 END::DOUBLE AS score
  FROM documents WHERE trim(text) <> '' AND strlen(text) <= 8192)
SELECT * FROM indexed ORDER BY score DESC, publication_id, chunk_index, chunk_id LIMIT 50""",
)
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over all documents, built, verified and searched."""
    root, provider = scratch_path(spark, "vector-index"), V.hash_axis_provider()
    V.build_index(_chunks(spark, sf_dir), root, provider, "1")
    return V.open_index(spark, root, provider, "1").search("the policy", provider, 50)


@register(
    "vector_index_faults",
    """WITH chunks AS (SELECT 'chunk:' || (CASE WHEN doc_id % 50 = 1 THEN doc_id - 1 ELSE doc_id END) AS chunk_id, CASE WHEN doc_id % 20 = 3 THEN doc_id - 1 ELSE doc_id END AS chunk_index,
  doc_id % 40 = 0 AS old, doc_id % 30 = 0 AS changed FROM documents)
SELECT 'version_mismatch' AS fault, count(*)::BIGINT AS chunks FROM chunks WHERE old UNION ALL
SELECT 'checksum_mismatch', count(*)::BIGINT FROM chunks WHERE changed UNION ALL
SELECT 'repeated_chunk_id', count(*)::BIGINT FROM (SELECT chunk_id FROM chunks GROUP BY 1 HAVING count(*) > 1) UNION ALL
SELECT 'repeated_position', count(*)::BIGINT FROM (SELECT chunk_index FROM chunks GROUP BY 1 HAVING count(*) > 1)""",
)
def vector_index_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that break each of the rules for building, counted by rule."""
    n = F.col("chunk_index")
    chunks = _chunks(spark, sf_dir).withColumns(
        {
            "chunk_id": F.concat(F.lit("chunk:"), F.when(n % 50 == 1, n - 1).otherwise(n)),
            "publication_id": F.lit("all"),
            "chunking_version": F.when(n % 40 == 0, "0").otherwise("1"),
            "text": F.when(n % 30 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")),
        }
    )
    chunks = chunks.withColumn("chunk_index", F.when(n % 20 == 3, n - 1).otherwise(n))
    return V.chunk_faults(chunks, "1").groupBy("fault").agg(F.count("*").alias("chunks"))


_DECISION = "CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'hold' ELSE 'reject' END"


@register(
    "review_log_stream",
    f"""WITH log AS (SELECT user_id % 20 AS run, user_id AS candidate_id, {_DECISION} AS decision, ts, event_id FROM events),
marked AS (SELECT *, max(ts) OVER (PARTITION BY run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log),
judged AS (SELECT *, coalesce(ts < before, FALSE) AS late FROM marked)
SELECT run::VARCHAR AS run_id, candidate_id::VARCHAR AS candidate_id, decision, event_id AS arrived, CASE WHEN late THEN 'rejected' ELSE 'accepted' END AS kind,
  CASE WHEN NOT late THEN count(*) FILTER (WHERE NOT late) OVER (PARTITION BY run ORDER BY event_id) END::BIGINT AS sequence FROM judged""",
)
def review_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of reviews in two parts, with a restart between them."""
    source, out, mark = (scratch_path(spark, f"reviews-{n}") for n in ("in", "out", "checkpoint"))
    kind, key = F.col("event_type"), F.col("event_id")
    decision = F.when(kind == "purchase", "approve").when(kind == "click", "hold").otherwise("reject")
    reviews = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).cast("string").alias("run_id"),
        F.col("user_id").cast("string").alias("candidate_id"),
        decision.alias("decision"),
        F.col("ts").cast("timestamp").alias("reviewed_at"),
        key.alias("arrived"),
    )
    middle = reviews.agg(F.max("arrived")).first()[0] or 0
    for part in (F.col("arrived") <= middle / 2, F.col("arrived") > middle / 2):
        reviews.filter(part).write.mode("append").parquet(source)
        R.run_review_log(spark.readStream.schema(reviews.schema).parquet(source), out, mark)
    return spark.read.parquet(out).select("run_id", "candidate_id", "decision", "arrived", "kind", "sequence")
