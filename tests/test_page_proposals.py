"""Pages proposed for questions: a task counts the pages of its piece, and only the best of each piece meet."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from corvane.operators import golden as Q
from corvane.operators.issues import question_flags
from corvane.sources.tables import MOST_PIECES, pieces


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_proposals_equal_plain_counts(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    asked = [(i, rng.sample(words, rng.randint(0, 9))) for i in range(30)] + [(90, None)]
    held = [(i, rng.randint(1, 5), rng.sample(words, rng.randint(0, 15))) for i in range(300)]
    held += [(7, held[7][1], words[:9]), (8, 99, words[:9]), (None, 3, words[:9]), (400, None, words[:9]), (401, 1, None), (402, 9, words[:3] * 2)]
    questions = spark.createDataFrame(asked, "question long, tokens array<string>")
    pages = spark.createDataFrame(held, "page long, size int, tokens array<string>")
    hits = Counter((q, p, s) for q, a in asked for p, s, t in held for w in set(a or ()) & set(t or ()))
    want = []
    for q in {q for q, *_ in hits}:
        # Descending sizes have null last, ascending pages first.
        order = sorted(((-n, -(s or 0), p if p is not None else -1, p, s) for (k, p, s), n in hits.items() if k == q))
        want += [(q, p, s, -n, place) for place, (n, _, _, p, s) in enumerate(order[:3], 1)]
    for n in (1, 7):
        got = Q.page_proposals(questions, pages.repartition(n), 3).select("question", "page", "size", "hits", "place").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_counts_of_pages_are_not_shuffled(spark, tmp_path, monkeypatch):
    """No exchange has a row for each question and page; the pieces that tasks count grow in number, not in size."""
    monkeypatch.setattr(Q, "PAGES", 1 << 10)
    tokens = F.array(*[F.concat(F.lit(f"t{i}-"), (F.col("id") % (5 + i)).cast("string")) for i in range(5)])
    spark.range(4000).select(F.col("id").alias("page"), F.lit(1).alias("size"), tokens.alias("tokens")).write.parquet(f"{tmp_path}/p")
    spark.range(50).select(F.col("id").alias("question"), tokens.alias("tokens")).write.parquet(f"{tmp_path}/q")
    pages, questions = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/q")
    found = Q.page_proposals(questions, pages, 3)
    plan = _plan(found)
    assert not re.search(r"hashpartitioning\(question#\d+L?, page#", plan)
    n = pieces(pages, 1 << 10)
    assert n > spark.sparkContext.defaultParallelism and re.search(rf"hashpartitioning\(page#\d+L?, size#\d+, {n}\)", plan)
    assert found.count() == 150


def test_pieces_of_tables_without_a_size(spark):
    rows = spark.createDataFrame([(1,)], "a int")
    assert spark.sparkContext.defaultParallelism <= pieces(spark.range(10), 1 << 20) <= MOST_PIECES
    assert pieces(rows, 1) <= MOST_PIECES and pieces(rows.crossJoin(rows), 1) <= MOST_PIECES


def test_only_asked_tokens_of_the_corpus_are_told_apart(spark, tmp_path):
    """The corpus' tokens are held against the asked ones before they are made distinct."""
    spark.range(100).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("token")).write.parquet(f"{tmp_path}/t")
    rows = [(1, "w1 w2", "", True, True), (2, "w1 zz yy", "", True, True), (3, "w3", "", True, False)]
    questions = spark.createDataFrame(rows, "id long, question string, answer string, mapped boolean, abstention boolean")
    corpus = spark.read.parquet(f"{tmp_path}/t")
    flags = question_flags(questions, ["the"], corpus.union(corpus))
    assert {r.id: list(r["flags"]) for r in flags.collect()} == {1: ["trap_topic_present"], 2: [], 3: []}
    assert "LeftSemi" in _plan(flags) and "SortMergeJoin [token" not in _plan(flags)
