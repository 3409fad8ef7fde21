"""Pairs of near token sets: equal sets are compared once, whatever their number."""

from __future__ import annotations

import random

from corvane.operators import golden as Q


def test_classes_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(Q, "MEMBERS", 8)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, rng.sample(words, rng.randint(0, 12))) for i in range(150)]
    rows += [(200 + i, words[:10]) for i in range(30)] + [(300 + i, words[1:11] + words[1:3]) for i in range(20)]
    rows += [(400, None), (None, words[:10])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = sorted(map(tuple, Q.jaccard_pairs(df, "id", "tokens", 0.7).collect()))
    sets = sorted((i, set(t)) for i, t in rows if i is not None and t)
    want = [(a, b, len(x & y) / len(x | y)) for a, x in sets for b, y in sets if a < b and len(x & y) / len(x | y) >= 0.7]
    assert got == want


def test_copies_are_not_compared(spark):
    """2,000 copies of one set and 2,000 of another near one are two sets to compare, not four million pairs."""
    a, b = [f"w{i}" for i in range(20)], [f"w{i}" for i in range(1, 21)]
    classes = spark.createDataFrame([(0, a), (1, b)], "rep long, s array<string>")
    assert [tuple(r) for r in Q.near_sets(classes, 0.7).collect()] == [(0, 1, 19 / 21)]
    df = spark.range(4000).selectExpr("id", "id % 2 AS k").join(classes.withColumnRenamed("rep", "k"), "k")
    assert Q.jaccard_pairs(df, "id", "s", 0.7).count() == 4000 * 3999 // 2
