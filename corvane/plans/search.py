"""Search queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import search as S
from corvane.plans.catalogue import register
from corvane.repository import Publications
from corvane.sources.tables import spread, table

_NORM = "trim(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^0-9a-z가-힣]+', ' ', 'g'))"


def _tf(column: str, term: str) -> str:
    return f"((length({column}) - length(replace({column}, '{term}', ''))) / {len(term)})::BIGINT"


def _lexical_sql(terms: list[str], fields: dict[str, tuple[str, float]], where: str = "TRUE", limit: str = "LIMIT 20") -> str:
    norm = ", ".join(f"{_NORM.format(sql)} AS {f}" for f, (sql, _) in fields.items())
    some = {t: " OR ".join(f"contains({f}, '{t}')" for f in fields) for t in terms}
    stats = ", ".join(f"count(*) FILTER (WHERE {some[t]}) AS df{i}" for i, t in enumerate(terms))
    parts = " + ".join(
        f"CASE WHEN {_tf(f, t)} > 0 THEN {w}::DOUBLE * (1.0::DOUBLE + ln({_tf(f, t)}::DOUBLE)) * (ln((n + 1)::DOUBLE / (df{i} + 1)) + 1.0::DOUBLE) ELSE 0.0::DOUBLE END"
        for f, (_, w) in fields.items()
        for i, t in enumerate(terms)
    )
    matched_fields = ", ".join(f"CASE WHEN {' OR '.join(f'{_tf(f, t)} > 0' for t in terms)} THEN '{f}' END" for f in fields)
    matched_terms = ", ".join(f"CASE WHEN {some[t]} THEN '{t}' END" for t in terms)
    return f"""
WITH texts AS (SELECT *, {norm} FROM (SELECT doc_id, lang, source, text AS body FROM documents)),
stats AS (SELECT count(*) AS n, {stats} FROM texts),
scored AS (SELECT doc_id, round({parts}, 8) AS score,
  list_filter([{matched_fields}], lambda x: x IS NOT NULL) AS mf, list_filter([{matched_terms}], lambda x: x IS NOT NULL) AS mt
  FROM texts, stats WHERE {where})
SELECT doc_id, round(score, 6) AS score, array_to_string(mf, ',') AS matched_fields, array_to_string(mt, ',') AS matched_terms
FROM scored WHERE score > 0 ORDER BY scored.score DESC, doc_id {limit}"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.round("score", 6).alias("score"),
        F.array_join("matched_fields", ",").alias("matched_fields"),
        F.array_join("matched_terms", ",").alias("matched_terms"),
    )


QUERY, TERMS = "The THAN policy erest", ["the", "than", "policy", "erest"]
_CONTENT = {"content": ("body", 1.0)}
_FIELDS = {"title": ("split_part(body, chr(10), 1)", 4.0), "content": ("body", 1.0)}


def _title() -> Column:
    return F.split_part(F.col("text"), F.lit("\n"), F.lit(1))


@register("lexical_topk", _lexical_sql(TERMS, _CONTENT))
def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.lexical_search(_docs(spark, sf_dir), QUERY, {"content": F.col("text")}, "doc_id", 20))


@register("lexical_multi_field", _lexical_sql(TERMS, _FIELDS))
def lexical_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"title": _title(), "content": F.col("text")}
    return _shown(S.lexical_search(_docs(spark, sf_dir), QUERY, fields, "doc_id", 20))


@register("lexical_filtered_global_idf", _lexical_sql(TERMS, _CONTENT, "lang = 'fr'"))
def lexical_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.col("lang").isin("fr")
    return _shown(S.lexical_search(_docs(spark, sf_dir), QUERY, {"content": F.col("text")}, "doc_id", 20, allowed))


@register("lexical_all_ranked", _lexical_sql(TERMS, _CONTENT, limit=""))
def lexical_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.lexical_search(_docs(spark, sf_dir), QUERY, {"content": F.col("text")}, "doc_id", None))


_KEYWORDS = ["nicht", "verschach", "und", "zeit"]


@register("lexical_related_keywords", _lexical_sql(_KEYWORDS, _CONTENT))
def lexical_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related by distinct keywords: their union is the query."""
    none = F.lit(None).cast("string")
    rows = _docs(spark, sf_dir).select(
        F.col("doc_id").alias("publication_id"), none.alias("title"), none.alias("abstract"), F.array().cast("array<string>").alias("keywords"), F.col("text").alias("content")
    )
    found = Publications(rows).find_related_by_keywords([*_KEYWORDS, "und"], 20)
    return _shown(found.withColumnRenamed("publication_id", "doc_id"))


@register("lexical_empty_query", "SELECT doc_id, 0.0::DOUBLE AS score, '' AS matched_fields, '' AS matched_terms FROM documents LIMIT 0")
def lexical_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(S.lexical_search(_docs(spark, sf_dir), " ... ", {"content": F.col("text")}, "doc_id", 20))


#: A fixed query vector of the production queries.
VECTOR = [((7 * i) % 11 - 5) / 10 for i in range(64)]
_Q = "[" + ", ".join(f"{v}::DOUBLE" for v in VECTOR) + "]"
_SCORED = f"""scored AS (SELECT vec_id, label, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
  list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), {_Q}))), 8) AS score FROM embeddings)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.nearest(table(spark, sf_dir, "embeddings"), VECTOR, "embedding", ["label", "vec_id"], None)


@register("vector_knn", f"WITH {_SCORED} SELECT vec_id, label, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, label, vec_id LIMIT 25")
def vector_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.nearest(table(spark, sf_dir, "embeddings"), VECTOR, "embedding", ["label", "vec_id"], 25)
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@register("vector_knn_allowed", f"WITH {_SCORED} SELECT vec_id, label, round(score, 6) AS score FROM scored WHERE label IN (1, 4) ORDER BY scored.score DESC, label, vec_id LIMIT 25")
def vector_knn_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = S.nearest(rows, VECTOR, "embedding", ["label", "vec_id"], 25, F.col("label").isin(1, 4))
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@register(
    "vector_best_per_publication",
    f"""WITH {_SCORED}, best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT label, vec_id, round(score, 6) AS score, round((score + 1) / 2, 6) AS legacy_score FROM best WHERE r = 1""",
)
def vector_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = S.project_publications(_scored(spark, sf_dir), "label", "vec_id")
    return best.select(
        "label", "vec_id", F.round("score", 6).alias("score"), F.round(S.legacy_score(F.col("score")), 6).alias("legacy_score")
    )


_RANKS = """chunks AS (SELECT *, row_number() OVER (ORDER BY score DESC, {p}, vec_id) AS chunk_rank FROM scored),
best AS (SELECT {p}, min(chunk_rank) AS chunk_rank, arg_min(score, chunk_rank) AS score, arg_min(vec_id, chunk_rank) AS vec_id FROM chunks GROUP BY {p}),
ranks AS (SELECT *, row_number() OVER (ORDER BY chunk_rank) AS observed_rank FROM best)"""


@register(
    "vector_source_depth",
    f"WITH {_SCORED}, {_RANKS.format(p='label')} SELECT label, chunk_rank, observed_rank, observed_rank > 3 AS truncated FROM ranks",
)
def vector_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = S.vector_ranks(_scored(spark, sf_dir), "label", "vec_id")
    return ranks.select("label", "chunk_rank", "observed_rank", (F.col("observed_rank") > 3).alias("truncated"))


def _hybrid(spark: SparkSession, sf_dir: str, limit: int, depth: int, with_vectors: bool = True) -> DataFrame:
    docs = _docs(spark, sf_dir)
    words = S.lexical_search(docs, QUERY, {"content": F.col("text")}, "doc_id", depth + 1)
    vectors = None
    if with_vectors:
        chunks = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.floor(F.col("vec_id") / 2))
        scored = S.nearest(chunks, VECTOR, "embedding", ["doc_id", "vec_id"], None)
        vectors = S.vector_ranks(scored, "doc_id", "vec_id")
    skipped = (
        docs.filter(F.octet_length("text") > 8192).groupBy("doc_id").agg(F.count("*").alias("skipped_chunks"))
    )
    return S.fuse(words, vectors, "doc_id", limit, skipped, depth=depth)


def _hybrid_sql(limit: int, depth: int, shown: str) -> str:
    lexical = _lexical_sql(TERMS, _CONTENT).strip().removeprefix("WITH ").rpartition("\nSELECT doc_id")[0]
    scored = _SCORED.replace("SELECT vec_id, label", "SELECT vec_id, vec_id // 2 AS doc_id").replace("scored AS", "vscored AS")
    ranks = _RANKS.format(p="doc_id").replace("FROM scored", "FROM vscored")
    return f"""WITH {lexical},
words AS (SELECT doc_id, score AS lexical_score, row_number() OVER (ORDER BY score DESC, doc_id) AS lexical_rank FROM scored WHERE score > 0
  QUALIFY lexical_rank <= {depth}),
{scored}, {ranks},
joined AS (SELECT coalesce(w.doc_id, r.doc_id) AS doc_id, lexical_rank, observed_rank,
   CASE WHEN observed_rank <= {depth} THEN observed_rank END AS vector_rank
   FROM words w FULL JOIN ranks r ON w.doc_id = r.doc_id WHERE lexical_rank IS NOT NULL OR observed_rank <= {depth}),
fused AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0), 12) AS fusion_score,
   CASE WHEN vector_rank IS NOT NULL THEN 'ranked' WHEN observed_rank IS NOT NULL THEN 'source_depth_truncated' ELSE 'not_indexed' END AS coverage
   FROM joined),
skipped AS (SELECT doc_id, count(*) AS skipped_chunks FROM documents WHERE strlen(text) > 8192 GROUP BY doc_id),
top AS (SELECT f.*, coalesce(skipped_chunks, 0)::BIGINT AS skipped_chunks, row_number() OVER (ORDER BY fusion_score DESC, f.doc_id)::INT AS rank
   FROM fused f LEFT JOIN skipped s ON f.doc_id = s.doc_id)
SELECT {shown} FROM top WHERE rank <= {limit}"""


@register("hybrid_rrf", _hybrid_sql(30, 100, "doc_id, rank, round(fusion_score, 9) AS fusion_score, lexical_rank::INT AS lexical_rank, vector_rank"))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hybrid(spark, sf_dir, 30, 100)
    return found.select("doc_id", "rank", F.round("fusion_score", 9).alias("fusion_score"), "lexical_rank", "vector_rank")


@register("hybrid_coverage", _hybrid_sql(40, 40, "doc_id, rank, coverage, observed_rank, skipped_chunks"))
def hybrid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 40, 40).select("doc_id", "rank", "coverage", "observed_rank", "skipped_chunks")


@register(
    "hybrid_lexical_only_fallback",
    _lexical_sql(TERMS, _CONTENT).replace(
        "SELECT doc_id, round(score, 6) AS score, array_to_string(mf, ',') AS matched_fields, array_to_string(mt, ',') AS matched_terms",
        "SELECT doc_id, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 9) AS fusion_score, 'unavailable' AS coverage",
    ),
)
def hybrid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _hybrid(spark, sf_dir, 20, 100, with_vectors=False)
    return found.select("doc_id", F.round("fusion_score", 9).alias("fusion_score"), "coverage")


_TOP = _lexical_sql(TERMS, _CONTENT).replace(
    "SELECT doc_id, round(score, 6) AS score, array_to_string(mf, ',') AS matched_fields, array_to_string(mt, ',') AS matched_terms",
    "SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS original_rank",
)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = S.lexical_search(docs, QUERY, {"content": F.col("text")}, "doc_id", 20)
    ranked = S.top_ranked(found, [F.desc("score"), F.col("doc_id")], 20)
    return ranked.join(docs.select("doc_id", F.length("text").alias("chars")), "doc_id")


@register("rerank_identity", f"SELECT doc_id, original_rank, original_rank AS rank FROM ({_TOP})")
def rerank_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rerank(_candidates(spark, sf_dir), "doc_id", None).select("doc_id", "original_rank", "rank")


@register(
    "rerank_by_score",
    f"""WITH top AS ({_TOP}) SELECT t.doc_id, original_rank, row_number() OVER (ORDER BY length(text) DESC, original_rank) AS rank
FROM top t JOIN documents d ON t.doc_id = d.doc_id""",
)
def rerank_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.rerank(_candidates(spark, sf_dir), "doc_id", F.col("chars").cast("double"))
    return found.select("doc_id", "original_rank", "rank")


@register(
    "embed_hash_axis",
    """SELECT doc_id, CASE WHEN trim(text) <> '' AND strlen(text) <= 8192
    THEN ((('0x' || substr(sha256(text), 16, 1))::INT) % 8)::INT END AS axis,
  CASE WHEN trim(text) = '' THEN 'empty_input' WHEN strlen(text) > 8192 THEN 'input_too_long' END AS failure_code FROM documents""",
)
def embed_hash_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _docs(spark, sf_dir).select("doc_id", S.hash_axis_embedding(F.col("text")).alias("e"))
    axis = F.when(F.col("e.values").isNotNull(), F.array_position("e.values", 1.0) - 1)
    return made.select("doc_id", axis.cast("int").alias("axis"), "e.failure_code")


@register(
    "vector_index_manifest",
    """SELECT count(*)::BIGINT AS input_chunks, count(*) FILTER (WHERE trim(text) <> '' AND strlen(text) <= 8192)::BIGINT AS indexed_chunks,
  count(*) FILTER (WHERE trim(text) = '')::BIGINT AS skipped_empty,
  count(*) FILTER (WHERE trim(text) <> '' AND strlen(text) > 8192)::BIGINT AS skipped_too_long FROM documents""",
)
def vector_index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_manifest(_docs(spark, sf_dir).select(S.hash_axis_embedding(F.col("text")).alias("e")).select("e.*"))
