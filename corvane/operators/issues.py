"""Search results and citations, recognised pages, novelty, planning cards, question flags, retried evaluators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.functions import urls as U
from corvane.operators.corpus import ocr_decision
from corvane.storage import materialise

#: Statuses whose pages may be recognised again.
OCR_STATUSES = ("low_text", "corrupt_text", "orphan_pdf")


def cited_results(results: DataFrame, citations: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Results (url, title, pos) on allowed domains that a citation (url, text) names, by canonical URL: the first title
    and all cited texts in order."""
    found = results.filter(U.allowed(F.col("url"), domains)).select(U.canonical(F.col("url")).alias("url"), "title", "pos")
    first = found.groupBy("url").agg(F.min_by("title", F.struct("pos", "title")).alias("title"))
    quoted = citations.select(U.canonical(F.col("url")).alias("url"), "text")
    return first.join(quoted, "url").groupBy("url", "title").agg(F.array_sort(F.collect_set("text")).alias("cited"))


def replay_recognition(pages: DataFrame, recorded: DataFrame) -> DataFrame:
    """Pages (doc, page, checksum) with their recorded recognition (checksum, text, confidence); none is a failure."""
    joined = pages.join(recorded, "checksum", "left")
    missing = F.col("text").isNull()
    return joined.withColumn("failure", F.when(missing, "provider_error"))


def recognise(pages: DataFrame, recognised: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Pages (doc, page, text, requires_ocr, status) merged with recognised ones (doc, page, ocr, confidence, failure).

    The result has the pages that either side knows. A page is eligible if its document asks for recognition and it is a blank page of the
    base, or if the document's status sends it to remediation. ``documents`` (doc, requires_ocr, status) tells this
    for documents without pages in the base; without it they are not eligible. Recognised text is taken only where it is better; ``decision`` says why or
    why not."""
    known = pages.groupBy("doc").agg(F.bool_or("requires_ocr").alias("requires_ocr"), F.max("status").alias("status")) if documents is None else documents
    base = pages.select("doc", "page", "text", F.lit(True).alias("__base"))
    blank = F.coalesce("__base", F.lit(False)) & F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)^\s*$")
    eligible = (F.col("requires_ocr") & blank) | F.col("status").isin(*OCR_STATUSES)
    joined = base.join(recognised.withColumn("__there", F.lit(True)), ["doc", "page"], "full_outer")
    joined = joined.join(known.select("doc", "requires_ocr", "status"), "doc", "left")
    decision = ocr_decision(F.col("text"), F.col("ocr"), F.col("confidence"), F.col("failure"))
    chosen = F.when(~F.coalesce(eligible, F.lit(False)), "not_eligible").when(F.col("__there").isNull(), "not_attempted").otherwise(decision)
    return joined.withColumn("decision", chosen).select(
        "doc",
        "page",
        F.when(F.col("decision") == "adopted", F.col("ocr")).otherwise(F.col("text")).alias("text"),
        "decision",
    )


def cap_novelty(candidates: DataFrame, similar: DataFrame, cap: float = 20.0, least: float = 0.96) -> DataFrame:
    """Candidates (candidate_id, title, novelty) with the first of their similar publications (candidate_id, pos,
    publication_id, title) whose title is all but equal; it caps their novelty. A candidate has a few similar ones, so
    the ratio is worked out on an equi-join."""
    each = candidates.select("candidate_id", X.canonical_text(F.col("title")).alias("a")).join(
        similar.select("candidate_id", "pos", "publication_id", X.canonical_text(F.col("title")).alias("b")), "candidate_id"
    )
    near = each.filter((F.col("a") != "") & (F.col("b") != "")).withColumn("r", X.match_ratio(F.col("a"), F.col("b")))
    first = near.filter(F.col("r") >= least).groupBy("candidate_id").agg(F.min_by("publication_id", "pos").alias("duplicate_of"))
    joined = candidates.join(first, "candidate_id", "left")
    return joined.withColumn(
        "novelty", F.when(F.col("duplicate_of").isNotNull(), F.least("novelty", F.lit(cap))).otherwise(F.col("novelty"))
    )


def planning_cards(
    approved: DataFrame, references: DataFrame, outlines: Mapping[str, Sequence[str]], gate: DataFrame | None = None, run: str = "run"
) -> DataFrame:
    """Cards of approved candidates (candidate_id, title, output_type, evidence): references by kind in the order of the
    evidence, an outline by output, and how far the evidence goes. With ``gate``, what :func:`corvane.operators.review.gate_status`
    gives, only candidates of runs that are ready get one."""
    if gate is not None:
        approved = approved.join(gate.filter("status = 'ready'").select(run), run, "left_semi")
    each = approved.select("candidate_id", F.posexplode("evidence").alias("pos", "id"))
    known = each.join(references.select("id", "kind"), "id")
    lists = known.groupBy("candidate_id").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("pos", "id")))), lambda s: s["id"]
            ).alias(f"{k}_ids")
            for k in ("publication", "external")
        ]
    )
    joined = approved.join(lists, "candidate_id", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    outline = F.create_map(*[x for k, v in outlines.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    both = (n(F.col("publication_ids")) > 0) & (n(F.col("external_ids")) > 0)
    label = F.when(both, "sufficient").when(n(F.col("publication_ids")) + n(F.col("external_ids")) > 0, "partial").otherwise("missing")
    return joined.withColumns({"outline": F.try_element_at(outline, F.col("output_type")), "sufficiency": label})


def question_flags(questions: DataFrame, endings: Sequence[str], corpus_tokens: DataFrame) -> DataFrame:
    """Flags of questions (id, question, answer, mapped, abstention): the answer stands in the question, a templated ending,
    no document, and abstention questions whose topic the corpus holds after all. ``corpus_tokens`` has (token)."""
    ask, answer = X.content_tokens(F.col("question")), X.content_tokens(F.col("answer"))
    rows = questions.withColumns({"__ask": ask, "__answer": answer})
    each = rows.filter("abstention").select("id", F.explode("__ask").alias("token"))
    # Only what is asked for is kept of the corpus' tokens, before they meet; stored, so that its size is known when that is planned.
    asked = materialise(each.select("token").distinct(), "asked-tokens")
    present = corpus_tokens.join(asked, "token", "left_semi").distinct()
    held = each.join(present, "token").groupBy("id").agg(F.count("*").alias("__held"))
    joined = rows.join(held, "id", "left")
    ends = F.lit(False)
    for e in endings:
        ends = ends | F.rtrim("question").endswith(e)
    share = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    leak = share(F.size(F.array_intersect("__answer", "__ask")), F.size("__answer"))
    trap = share(F.coalesce(F.col("__held"), F.lit(0)), F.size("__ask"))
    flags = [
        ("answer_leak", leak > 0.5),
        ("templated", ends),
        ("unmapped_document", ~F.col("mapped") & ~F.col("abstention")),
        ("trap_topic_present", F.col("abstention") & (trap > 0.9)),
    ]
    named = F.array_compact(F.array(*[F.when(c, n) for n, c in flags]))
    return joined.select("id", named.alias("flags"))


_RESULT = "candidate_id string, criterion string, score double, attempts int, failure string"


def evaluate(candidates: DataFrame, evaluators: Mapping[str, Callable[[str], float]], attempts: int = 2) -> DataFrame:
    """Every candidate (candidate_id, text) by every evaluator, each tried ``attempts`` times; what fails to the end is a
    row with the error. A retry is part of the evaluation, so it happens here and not as a task's."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                for name, evaluator in sorted(evaluators.items()):
                    score, failure, n = None, None, 0
                    while n < attempts:
                        n += 1
                        try:
                            score, failure = float(evaluator(r.text)), None
                            break
                        except Exception as error:  # noqa: BLE001  an evaluator may fail in any way
                            failure = type(error).__name__
                    out.append((r.candidate_id, name, score, n, failure))
            yield pd.DataFrame(out, columns=["candidate_id", "criterion", "score", "attempts", "failure"])

    return candidates.select("candidate_id", "text").mapInPandas(run, _RESULT)


def retry_count(attempts: Column) -> Column:
    """Aggregate: attempts beyond the first."""
    return F.coalesce(F.sum(F.greatest(attempts - 1, F.lit(0))), F.lit(0)).cast("long")
