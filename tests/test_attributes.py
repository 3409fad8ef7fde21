"""Small rules about candidates, signals and publications."""

from __future__ import annotations

import hashlib
from datetime import date

from pyspark.sql import functions as F

from corvane.operators import attributes as A
from corvane.operators import signals as G


def test_names(spark):
    df = spark.createDataFrame([(" 국방부(MND) ",), ("CSIS",), ("Some  Press",), (None,)], "p string").select(A.publisher_name(F.col("p")).alias("p"))
    assert [r.p for r in df.collect()] == ["대한민국 국방부", "전략국제문제연구소(CSIS)", "Some Press", None]
    df = spark.createDataFrame([(" KIDA Brief",), ("정책연구",), ("x",), (None,)], "o string").select(A.output_type(F.col("o")).alias("o")).select("o", A.horizon(F.col("o")).alias("h"))
    assert [tuple(r) for r in df.collect()] == [("kida_brief", "short_term"), ("defense_policy_research", "structural"), (None, "unknown"), (None, "unknown")]
    source = spark.createDataFrame([("T", "http://A.com/x", "csis")], "title string, url string, publisher string")
    assert G.normalise_sources(source).first()["publisher"] == "전략국제문제연구소(CSIS)"


def test_texts_years_and_times(spark):
    df = spark.createDataFrame([("　 a b \n", 2020, date(2021, 1, 1)), ("  ", 2020, date(2020, 5, 5)), (None, None, date(2020, 5, 5)), ("x" * 5000, 2020, None)], "t string, y int, d date")
    got = df.select(A.excerpt(F.col("t")).alias("t"), A.year_conflict(F.col("y"), F.col("d")).alias("c"), A.effective_time(F.col("y"), F.lit(2020)).alias("e")).collect()
    assert [r.t for r in got] == ["a b", None, None, "x" * 4000]
    assert [r.c for r in got] == [True, False, False, False] and {r.e for r in got} == {2020}


def test_attributes(spark):
    candidates = [(1, "드론 and AI", "북한 또는 미국", "defense_forum"), (2, "said", None, "research_report"), (3, "aid", "x", None)]
    c = spark.createDataFrame(candidates, "candidate_id int, title string, question string, output string")
    signals = [(2, 5, ["b", "a"], ["K"]), (2, 1, ["a", None], []), (1, 1, [], ["J"])]
    s = spark.createDataFrame(signals, "candidate_id int, pos int, policy_domains array<string>, countries array<string>")
    got = {r.candidate_id: (list(r.policy_domains), list(r.countries), r.output_type, r.research_horizon) for r in A.candidate_attributes(c, s).collect()}
    assert got[1] == (["국방인공지능", "무인체계"], ["J"], "defense_forum", "short_term")
    assert got[2] == (["a", "b"], ["K"], "research_report", "structural") and got[3] == ([], [], None, "unknown")


def test_official_sources(spark):
    rows = [(1, "external_news", [], "tier_3_news"), (1, "internal", ["s"], A.OFFICIAL), (2, "external_x", None, None), (3, "internal", None, A.OFFICIAL), (4, None, ["s"], "tier_3_news")]
    s = spark.createDataFrame(rows, "candidate_id int, signal_type string, source_ids array<string>, reliability_tier string")
    assert {r.candidate_id: r.unofficial for r in A.without_official_source(s).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_source_checksum(spark):
    pubs = spark.createDataFrame([("a", "t", "own", "x/a.pdf"), ("b", "t", None, None), ("c", "t", None, "x/c.pdf"), ("d", "t", None, None)], "publication_id string, publication_type string, checksum string, path string")
    pages = spark.createDataFrame([("b", 1, "x", "s"), ("b", 2, "y", "s"), ("c", 2, "é", "s2"), ("c", 1, None, "s1")], "publication_id string, page int, text string, source_checksum string")
    got = {r.publication_id: r.source_checksum for r in A.source_checksums(pubs, pages).collect()}
    digest = lambda *parts: hashlib.sha256(b"".join(len(p.encode()).to_bytes(8, "big") + p.encode() for p in parts)).hexdigest()
    assert got == {"a": "own", "b": "s", "c": digest("c", "t", "c.pdf", "1", "", "s1", "2", "é", "s2"), "d": digest("d", "t", "")}
