"""Near-duplicate candidates against the plain walk over a list."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import candidates as C

SCHEMA = "id long, rank int, title string, question string, t string, place string"


def walk(rows, least=0.9):
    """The rule as it is said: one after the other, against all that were kept."""
    fold = lambda s: re.sub(r"[^0-9a-z가-힣]+", "", (s or "").lower())

    def near(a, b):
        m = SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least

    kept, out = [], {}
    for i, rank, title, question, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        t, q = fold(title), fold(question)
        out[i] = next((k for k, kt, kq in kept if near(t, kt) and near(q, kq)), None)
        if out[i] is None:
            kept.append((i, t, q))
    return {(i, o is None, o) for i, o in out.items()}


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é", "q"])
    return "".join(s)


def texts(rng, n_words):
    return " ".join("".join(rng.choice("abcdeo") for _ in range(rng.randint(2, 6))) for _ in range(n_words))


def test_chains_and_edges(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        t, q = texts(rng, rng.randint(1, 5)), texts(rng, rng.randint(3, 40))
        for _ in range(rng.randint(1, 6)):  # a chain: each near the one before it, the ends far from each other
            rows.append((len(rows), rng.randint(0, 50), t, q, "", ""))
            t, q = mutate(rng, t, rng.randint(0, 2)), mutate(rng, q, rng.randint(0, 4))
    rows += [(1000 + i, 3, "same title", "same question here", "", "") for i in range(200)]
    rows += [(2000, None, None, None, "", ""), (2001, 1, "", "  ", "", ""), (2002, 1, "abc", "abcd", "", ""), (2003, 2, "abc", "abcd!", "", "")]
    rows += [(2004, 2, "abc", "abce", "", ""), (2005, 2, "", "same question here", "", ""), (2006, 9, "A-B-C-D-E", "x" * 300, "", ""), (2007, 9, "abcde", "x" * 298, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = {tuple(r) for r in C.drop_near_duplicates(docs, "id", "title", "question", ["rank"]).collect()}
    assert got == walk(rows)


def test_long_chain_settles_in_order(spark):
    """1 - 2 - 3 - ... : every second one stays."""
    pairs = spark.createDataFrame([(i, i + 1) for i in range(9)], "earlier long, later long")
    assert {r[0] for r in C.settle(pairs).collect()} == {1, 3, 5, 7, 9}


def test_empty(spark):
    assert C.drop_near_duplicates(spark.createDataFrame([], SCHEMA), "id", "title", "question", ["rank"]).collect() == []


def test_lower_ratio_is_refused(spark):
    with pytest.raises(ValueError):
        C.near_pairs(spark.createDataFrame([], "place long, t string, q string"), 0.8)


@settings(max_examples=400, deadline=None)
@given(st.text("ab", min_size=5, max_size=60), st.lists(st.tuples(st.integers(0, 60), st.sampled_from(["", "a", "b", "c"])), max_size=5))
def test_near_texts_share_as_many_pieces_as_said(a, edits):
    b = a
    for at, c in edits:
        b = b[: at % (len(b) + 1)] + c + b[at % (len(b) + 1) + (c == "") :]
    if len(b) <= C.EQUAL_ONLY or a == b or SequenceMatcher(None, a, b).ratio() < 0.9:
        return
    from collections import Counter

    pieces = lambda s: Counter(s[i : i + 3] for i in range(len(s) - 2))
    shared = sum((pieces(a) & pieces(b)).values())
    for s in (a, b):
        shortest = (9 * len(s) + 10) // 11
        assert shared >= max(1, (len(s) + shortest - 5) // 4)


def test_part_table(spark):
    from corvane.plans import catalogue

    path = "/root/testdata/sf0.001"
    got = {tuple(r) for r in catalogue.queries()["candidate_near_duplicates"](spark, path).collect()}
    part = spark.read.parquet(f"{path}/part.parquet")
    rows = part.select("p_partkey", F.lit(0), "p_name", F.concat_ws(" ", "p_type", "p_brand", "p_size", "p_retailprice")).collect()
    assert got == walk(map(tuple, rows))


def test_bits_lose_no_near_pair():
    """Blocks of short texts let every near pair through, each once, and few others."""
    import numpy as np

    from corvane.operators.short_texts import LONGER, WORD, Block, possible

    rng = random.Random(1)
    texts = {""}
    for _ in range(120):
        s = "".join(rng.choice("abcd1é가") for _ in range(rng.randint(0, LONGER)))
        for _ in range(4):
            texts.add(s[:LONGER])
            s = mutate(rng, s, rng.randint(0, 4))
    texts = sorted(texts)
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if min(len(texts[i]), len(texts[j])) <= WORD]
    near = {(i, j) for i, j in pairs if max(SequenceMatcher(None, *p).ratio() for p in ((texts[i], texts[j]), (texts[j], texts[i]))) >= 0.9}
    whole, half = Block(np.arange(len(texts)), texts), len(texts) // 2
    left, right = Block(np.arange(half), texts[:half]), Block(np.arange(half, len(texts)), texts[half:])
    for a, b, same in ((whole, whole, True), (left, right, False)):
        got = [tuple(sorted(p)) for found in possible(a, b, same, 0.9) for p in zip(*(x.tolist() for x in found))]
        assert len(got) == len(set(got)) < len(pairs) / 20
        assert {p for p in near if same or p[0] < half <= p[1]} <= set(got)


def test_short_titles_are_not_joined_on_pieces(spark):
    """Titles of a few syllables share pieces with most others; the join on pieces made a large part of all pairs."""
    rng = random.Random(2)
    titles = {"".join(rng.choice(["the", "and", "tion", "er"]) for _ in range(12)) for _ in range(1500)}
    df = spark.createDataFrame([(t,) for t in sorted(titles)], "t string")
    near = C.near_titles(df, 0.92)
    assert C._rare_pieces(df.filter(F.length("t") > C.WORD), "t", "t", "tp").isEmpty()
    some = sorted(titles)[:40]
    got = {(r.t, r.of) for r in near.collect() if r.t in some and r.of in some}
    assert got == {(a, b) for a in some for b in some if SequenceMatcher(None, a, b).ratio() >= 0.92}
