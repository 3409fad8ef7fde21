"""The audit of a set of questions against the corpus: which answers no accepted page holds, and what else speaks against a
question. Everything is counted after equi-joins on tokens; no question is compared with every page or every other question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.golden import jaccard_pairs
from corvane.operators.issues import question_flags
from corvane.operators.ranking import rank_all
from corvane.storage import materialise

#: The share of an answer's tokens that its pages must hold, the Jaccard similarity of near questions, and the
#: markers of front matter, two of which make a page one.
GROUNDED, NEAR, FRONT_MATTER, FRONT_HITS = 0.5, 0.7, ("발행처", "발행인", "편집인", "편집장", "ISSN"), 2


def is_front_matter(text: Column, markers: Sequence[str] = FRONT_MATTER, hits: int = FRONT_HITS) -> Column:
    """A page that repeats title and author and holds no evidence: several markers of a masthead stand in it."""
    found = F.lit(0)
    for m in markers:
        found = found + F.coalesce(text, F.lit("")).contains(m).cast("int")
    return found >= hits


def grounding(questions: DataFrame, accepted: DataFrame) -> DataFrame:
    """(id, tokens, grounding): the share of each answer's distinct tokens that its accepted pages hold together. ``questions`` has
    (id, answer), ``accepted`` (id, text) with any number of pages for each. Questions without answer tokens or pages
    have no row."""
    asked = questions.select("id", F.explode(X.content_tokens(F.col("answer"))).alias("token"))
    held = accepted.select("id", F.explode(X.content_tokens(F.col("text"))).alias("token")).distinct()
    joined = asked.join(held.withColumn("there", F.lit(1)), ["id", "token"], "left")
    shares = joined.groupBy("id").agg(F.count("*").alias("tokens"), (F.count("there") / F.count("*")).alias("grounding"))
    return shares.join(accepted.select("id").distinct(), "id", "left_semi")


def audit_questions(
    questions: DataFrame,
    accepted: DataFrame,
    corpus_tokens: DataFrame,
    endings: Sequence[str],
    decided: DataFrame | None = None,
    grounded: float = GROUNDED,
    near: float = NEAR,
) -> DataFrame:
    """(id, grounding, flags, near_duplicates, risk_rank, decided) of questions (id, question, answer, abstention).

    ``accepted`` has the pages (id, text) that were accepted for each question; a question with none is not mapped. ``corpus_tokens`` has
    the corpus' tokens (token). Flags, in this order: low_grounding, answer_leak, templated, unmapped_document, trap_topic_present, near_duplicate. An abstention
    asserts that nothing is there, so its answer is not grounded. Of near questions the one of the smaller id names the others.
    ``risk_rank`` counts from 1 by number of flags, most first, and id. ``decided`` (id) marks questions that a reviewer has
    settled. Ids are unique; null texts are empty.
    """
    questions = materialise(questions, "audit-questions")
    accepted = materialise(accepted, "audit-pages")
    mapped = accepted.select("id").distinct().withColumn("mapped", F.lit(True))
    known = questions.join(mapped, "id", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))
    plain = question_flags(known, endings, corpus_tokens)
    shares = grounding(questions.filter("NOT abstention"), accepted).drop("tokens")
    items = questions.select("id", X.content_tokens(F.col("question")).alias("tokens"))
    partners = jaccard_pairs(items, "id", "tokens", near).groupBy(F.col("a").alias("id")).agg(F.array_sort(F.collect_list("b")).alias("near_duplicates"))
    joined = questions.select("id").join(plain, "id").join(shares, "id", "left").join(partners, "id", "left")
    low = F.when(F.col("grounding") < grounded, F.lit("low_grounding"))
    close = F.when(F.col("near_duplicates").isNotNull(), F.lit("near_duplicate"))
    flags = F.array_compact(F.concat(F.array(low), F.col("flags"), F.array(close)))
    flagged = joined.withColumn("flags", flags)
    ranked = rank_all(flagged, [-F.size("flags"), F.col("id")], "risk_rank")
    if decided is None:
        return ranked.withColumn("decided", F.lit(False))
    marks = decided.select("id").distinct().withColumn("decided", F.lit(True))
    return ranked.join(marks, "id", "left").withColumn("decided", F.coalesce("decided", F.lit(False)))


def accepted_drafts(drafts: DataFrame, verdicts: DataFrame, key: str, keep: Sequence[str], decided: DataFrame | None = None) -> DataFrame:
    """Drafts whose verdict is to accept them, abstentions left out, with the drafts' columns of ``keep`` (null where there is no draft).
    ``verdicts`` has (key, verdict, query_slice); ``decision_basis`` tells what a reviewer settled before."""
    taken = verdicts.filter((F.lower(F.trim(F.coalesce("verdict", F.lit("")))) == "accept") & ~F.col("query_slice").eqNullSafe("abstention"))
    joined = taken.join(drafts.select(key, *keep), key, "left")
    if decided is None:
        return joined.withColumn("decision_basis", F.lit(""))
    marks = decided.select(key).distinct().withColumn("__decided", F.lit(True))
    return joined.join(marks, key, "left").withColumn("decision_basis", F.when(F.col("__decided"), "(decided)").otherwise("")).drop("__decided")
