"""Lexical, vector and fused search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.ranking import best_per_group, rank_all, top_ranked
from corvane.storage import materialise

#: Weights of the search fields, and the constant of rank fusion.
FIELD_WEIGHTS = {"title": 4.0, "abstract": 3.0, "keywords": 3.5, "content": 1.0}
RRF_K = 60
SOURCE_DEPTH = 100


def lexical_search(
    docs: DataFrame,
    query: str,
    fields: Mapping[str, Column],
    id_col: str,
    limit: int | None,
    allowed: Column | None = None,
    weights: Mapping[str, float] = FIELD_WEIGHTS,
) -> DataFrame:
    """Columns (id_col, score, matched_fields, matched_terms), best first.

    A term counts wherever its characters stand, in any normal form. The counts are written at the call. Document frequencies come from all of ``docs``; ``allowed`` only
    restricts what is ranked. ``limit`` None ranks all.
    """
    terms = X.query_terms(query)
    schema = [F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched_fields")]
    if not terms or (limit is not None and limit <= 0):
        return docs.select(id_col, *schema, F.array().cast("array<string>").alias("matched_terms")).limit(0)
    texts = docs.select(
        id_col,
        (allowed if allowed is not None else F.lit(True)).alias("__allowed"),
        *[X.fold(X.composed(F.coalesce(c, F.lit("")))).alias(f"__{f}") for f, c in fields.items()],
    )
    # Terms hold kept characters only, so they stand in the folded text as often as in what a clean-up would leave of it.
    # Text is read once: what remains is a count for each field and term.
    counts = {(f, i): F.col(f"__tf_{f}_{i}") for f in fields for i in range(len(terms))}
    counted = materialise(
        texts.select(
            id_col,
            "__allowed",
            *[X.term_count(F.col(f"__{f}"), terms[i]).cast("long").alias(f"__tf_{f}_{i}") for f, i in counts],
        ),
        "term-counts",
    )
    somewhere = [reduce(or_, [counts[f, i] > 0 for f in fields]) for i in range(len(terms))]
    stats = counted.agg(F.count("*").alias("__n"), *[F.count_if(c).alias(f"__df{i}") for i, c in enumerate(somewhere)])
    scored = counted.filter("__allowed").filter(reduce(or_, somewhere)).crossJoin(F.broadcast(stats))  # one row
    score, in_field, in_term = F.lit(0.0), {}, somewhere
    for f in fields:
        in_field[f] = reduce(or_, [counts[f, i] > 0 for i in range(len(terms))])
        for i in range(len(terms)):
            tf = counts[f, i]
            idf = F.ln((F.col("__n") + 1).cast("double") / (F.col(f"__df{i}") + 1)) + 1.0
            part = F.lit(float(weights[f])) * (F.lit(1.0) + F.ln(tf.cast("double"))) * idf
            score = score + F.when(tf > 0, part).otherwise(0.0)
    named = lambda pairs: F.filter(F.array(*[F.when(c, n) for n, c in pairs]), lambda v: v.isNotNull())
    found = scored.select(
        id_col,
        F.round(score, 8).alias("score"),
        named(in_field.items()).alias("matched_fields"),
        named(zip(terms, in_term, strict=True)).alias("matched_terms"),
    ).filter("score > 0")
    ordered = found.orderBy(F.desc("score"), id_col)
    return ordered if limit is None else ordered.limit(limit)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine in [-1, 1]; null for a zero vector."""
    q = F.array(*[F.lit(float(v)) for v in query])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    norm = F.sqrt(total(F.transform(v, lambda a: a * a))) * F.lit(sum(x * x for x in query) ** 0.5)
    return F.when(norm > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / norm)))


def nearest(
    chunks: DataFrame, query: Sequence[float], vector: str, order: Sequence[str], limit: int | None, allowed: Column | None = None
) -> DataFrame:
    """Exact scan: ``chunks`` without the vector, with score, best first, ties by ``order``."""
    rows = chunks.filter(allowed) if allowed is not None else chunks
    scored = rows.withColumn("score", F.round(cosine(F.col(vector), query), 8)).drop(vector).filter("score IS NOT NULL")
    ordered = scored.orderBy(F.desc("score"), *order)
    return ordered if limit is None else ordered.limit(limit)


def legacy_score(score: Column) -> Column:
    return (score + 1) / 2


def project_publications(scored: DataFrame, publication: str, chunk: str) -> DataFrame:
    """The best chunk of each publication."""
    return best_per_group(scored, [publication], [-F.col("score"), F.col(chunk)], ["score", chunk])


def vector_ranks(scored: DataFrame, publication: str, chunk: str) -> DataFrame:
    """Publications by their best chunk: (publication, score, chunk, chunk_rank, observed_rank)."""
    chunks = rank_all(scored, [F.desc("score"), F.col(publication), F.col(chunk)], "chunk_rank")
    best = best_per_group(chunks, [publication], [F.col("chunk_rank")], ["score", chunk, "chunk_rank"])
    return rank_all(best, [F.col("chunk_rank")], "observed_rank")


def fuse(
    lexical: DataFrame,
    vector: DataFrame | None,
    id_col: str,
    limit: int,
    skipped: DataFrame | None = None,
    k: int = RRF_K,
    depth: int = SOURCE_DEPTH,
) -> DataFrame:
    """Reciprocal rank fusion of ranked sources.

    ``lexical`` has (id_col, score, matched_fields, matched_terms); ``vector`` what :func:`vector_ranks` gives,
    None if there is no index. Each source counts down to ``depth``; a publication beyond it keeps its observed rank.
    """
    depth = max(depth, limit)
    words = top_ranked(lexical, [F.desc("score"), F.col(id_col)], depth, "lexical_rank").select(
        id_col, F.col("score").alias("lexical_score"), "lexical_rank"
    )
    if vector is None:
        joined = words.withColumns(
            {n: F.lit(None).cast(t) for n, t in (("vector_score", "double"), ("vector_rank", "long"), ("observed_rank", "long"))}
        )
        coverage = F.lit("unavailable")
    else:
        ranks = vector.select(id_col, F.col("score").alias("vector_score"), "observed_rank")
        within = ranks.filter(F.col("observed_rank") <= depth)
        # Beyond the depth only publications that the other source ranks are of interest.
        beyond = ranks.filter(F.col("observed_rank") > depth).join(words.select(id_col), id_col, "left_semi")
        joined = words.join(within.unionByName(beyond), id_col, "full_outer").withColumn(
            "vector_rank", F.when(F.col("observed_rank") <= depth, F.col("observed_rank"))
        )
        coverage = (
            F.when(F.col("vector_rank").isNotNull(), "ranked")
            .when(F.col("observed_rank").isNotNull(), "source_depth_truncated")
            .otherwise("not_indexed")
        )
        joined = joined.withColumn("vector_score", F.when(F.col("vector_rank").isNotNull(), F.col("vector_score")))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    fused = joined.withColumn("fusion_score", F.round(part("lexical_rank") + part("vector_rank"), 12)).withColumn(
        "coverage", coverage
    )
    if skipped is not None:
        fused = fused.join(skipped, id_col, "left")
    counted = F.coalesce(F.col("skipped_chunks"), F.lit(0)) if skipped is not None else F.lit(0)
    fused = fused.withColumn("skipped_chunks", counted.cast("long"))
    return top_ranked(fused, [F.desc("fusion_score"), F.col(id_col)], limit)


def rerank(ranked: DataFrame, id_col: str, score: Column | None) -> DataFrame:
    """A permutation of ranked candidates with ``original_rank``; without scores, or if one is missing, the order stays."""
    rows = ranked.withColumnRenamed("rank", "original_rank")
    if score is None:
        return rows.withColumns({"rank": F.col("original_rank"), "rerank_score": F.lit(None).cast("double")})
    scored = rows.withColumn("rerank_score", score)
    broken = scored.agg(F.coalesce(F.bool_or(F.col("rerank_score").isNull()), F.lit(False)).alias("__broken"))
    key = F.when(F.col("__broken"), F.col("original_rank").cast("double")).otherwise(-F.col("rerank_score"))
    keyed = scored.crossJoin(F.broadcast(broken)).withColumn("__key", key)
    placed = rank_all(keyed, [F.col("__key"), F.col("original_rank"), F.col(id_col)])
    return placed.withColumn("rerank_score", F.when(~F.col("__broken"), F.col("rerank_score"))).drop("__key", "__broken")


def hash_axis_embedding(text: Column, dimensions: int = 8, max_bytes: int = 8192) -> Column:
    """Struct (values, failure_code): a unit vector along the axis that the text's SHA-256 names. Blank texts and texts
    of more than ``max_bytes`` fail."""
    head = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    axis = (head % F.lit(dimensions)).cast("int")
    values = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: (i == axis).cast("double"))
    failure = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty_input").when(
        F.octet_length(text) > max_bytes, "input_too_long"
    )
    return F.struct(F.when(failure.isNull(), values).alias("values"), failure.alias("failure_code"))


def index_manifest(embedded: DataFrame, failure: str = "failure_code") -> DataFrame:
    """One row: inputs, indexed, and skipped by cause."""
    return embedded.agg(
        F.count("*").alias("input_chunks"),
        F.count_if(F.col(failure).isNull()).alias("indexed_chunks"),
        F.count_if(F.col(failure) == "empty_input").alias("skipped_empty"),
        F.count_if(F.col(failure) == "input_too_long").alias("skipped_too_long"),
    )
