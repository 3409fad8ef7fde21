"""Search, scoring, review, analysis, components and streams on small fixtures."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import analysis as A
from corvane.operators import review as R
from corvane.operators import scoring as P
from corvane.operators import search as S
from corvane.operators import signals as G
from corvane.operators.components import connected_components
from corvane.operators.prefix_sums import running_total
from corvane.operators.ranking import rank_all
from corvane.repository import Filters, Publications
from corvane.streaming import review_log as L


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_running_total(spark):
    rng = random.Random(0)
    data = [("g" if rng.random() < 0.7 else "h", f"{rng.getrandbits(64):016X}", i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "g string, h string, i long, v long")
    for digits in (1, 2, 4):
        got = {r["i"]: r["t"] for r in rows(running_total(df, ["g"], "h", ["i"], F.col("v"), "t", digits))}
        seen = {}
        for g, h, i, v in sorted(data, key=lambda r: (r[1], r[2])):
            assert got[i] == seen.get(g, 0)
            seen[g] = seen.get(g, 0) + v


def test_rank_all(spark):
    df = spark.createDataFrame([(random.Random(i).randint(0, 50), i) for i in range(300)], "v long, i long").repartition(6)
    got = sorted(rows(rank_all(df, [F.desc("v"), F.col("i")])), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 301))
    assert [(r["v"], r["i"]) for r in got] == sorted(((r["v"], r["i"]) for r in got), key=lambda x: (-x[0], x[1]))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in rows(connected_components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {n: find(n) for n in root if any(a != b and n in (a, b) for a, b in edges)}


PUBS = "publication_id string, publication_type string, title string, abstract string, keywords array<string>, content string, authors array<string>, publication_date date, filename_year int"


@pytest.fixture(scope="module")
def pubs(spark):
    day = dt.date(2024, 7, 1)
    data = [
        ("p1", "brief", "Drone policy", "", [], "drones and drones", ["Kim Younghee"], day, 2024),
        ("p2", "forum", "Other", "drone", ["drone"], "nothing", ["Lee"], None, 2022),
        ("p3", "brief", "Third", None, None, "drone drone drone", ["Park"], dt.date(2023, 1, 5), None),
        ("p4", "forum", "Undated", "", [], "", [], None, None),
    ]
    return Publications(spark.createDataFrame(data, PUBS))


def test_repository(pubs):
    found = rows(pubs.search("DRONE", limit=10))
    assert [r["publication_id"] for r in found] == ["p2", "p1", "p3"]
    assert found[0]["matched_fields"] == ["abstract", "keywords"] and found[1]["matched_terms"] == ["drone"]
    # Frequencies come from the whole table even if the filter leaves one row.
    alone = rows(pubs.search("drone", Filters(types=["brief"], authors=["younghee"])))
    assert alone == [r for r in found if r["publication_id"] == "p1"]
    assert rows(pubs.search("  ?", limit=5)) == [] and rows(pubs.search("drone", limit=0)) == []
    assert [r["publication_id"] for r in rows(pubs.search("drone", Filters(start="2022-07-01", end="2022-07-31")))] == ["p2"]
    assert [r["publication_id"] for r in rows(pubs.recent(3))] == ["p1", "p3", "p2"]
    assert sum(r["n"] for r in rows(pubs.distribution())) == 4 and sum(r["n"] for r in rows(pubs.distribution(2022, 2024))) == 3
    assert [r["publication_id"] for r in rows(pubs.find_similar("Third", ""))] == ["p3"]


def ranked(spark, ids, name="score"):
    return spark.createDataFrame([(i, float(len(ids) - n), [], []) for n, i in enumerate(ids)], "id string, score double, matched_fields array<string>, matched_terms array<string>")


def test_fusion(spark):
    lexical = ranked(spark, ["a", "b", "c"])
    vector = spark.createDataFrame([("b", 0.9, 1, 1, 1), ("c", 0.8, 2, 2, 2), ("a", 0.7, 3, 3, 3)], "id string, score double, chunk long, chunk_rank long, observed_rank long")
    got = sorted(rows(S.fuse(lexical, vector, "id", 10)), key=lambda r: r["rank"])
    assert [r["id"] for r in got] == ["b", "a", "c"]
    assert got[0]["fusion_score"] == pytest.approx(1 / 62 + 1 / 61)
    deep = vector.withColumn("observed_rank", F.when(F.col("id") == "a", 4).otherwise(F.col("observed_rank")).cast("long"))
    got = {r["id"]: r for r in rows(S.fuse(lexical, deep, "id", 3, depth=3))}
    assert got["a"]["coverage"] == "source_depth_truncated" and got["a"]["observed_rank"] == 4
    assert got["a"]["fusion_score"] == pytest.approx(1 / 61)
    only = rows(S.fuse(lexical, None, "id", 10))
    assert {r["coverage"] for r in only} == {"unavailable"} and len(only) == 3


def test_vectors(spark):
    chunks = spark.createDataFrame([("p", 0, [1.0, 0.0]), ("p", 1, [0.6, 0.8]), ("q", 2, [0.6, 0.8]), ("r", 3, [0.0, 0.0]), ("s", 4, [-1.0, 0.0])], "pub string, chunk long, v array<double>")
    found = rows(S.nearest(chunks, [1.0, 0.0], "v", ["pub", "chunk"], None))
    assert [(r["chunk"], r["score"]) for r in found] == [(0, 1.0), (1, 0.6), (2, 0.6), (4, -1.0)]
    best = {r["pub"]: r["chunk"] for r in rows(S.project_publications(S.nearest(chunks, [1.0, 0.0], "v", ["pub"], None), "pub", "chunk"))}
    assert best == {"p": 0, "q": 2, "s": 4}


def test_rerank_fails_open(spark):
    base = spark.createDataFrame([("a", 1, 0.1), ("b", 2, 0.9), ("c", 3, None)], "id string, rank long, s double")
    got = {r["id"]: (r["original_rank"], r["rank"]) for r in rows(S.rerank(base, "id", F.col("s")))}
    assert got == {"a": (1, 1), "b": (2, 2), "c": (3, 3)}
    got = {r["id"]: r["rank"] for r in rows(S.rerank(base.filter("s IS NOT NULL"), "id", F.col("s")))}
    assert got == {"a": 2, "b": 1}


def test_embedding(spark):
    import hashlib

    texts = ["some text", "가" * 3000, " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.hash_axis_embedding(F.col("t"), 12).alias("e"))
    got = [r["e"] for r in rows(df)]
    axis = int.from_bytes(hashlib.sha256(b"some text").digest()[:8], "big") % 12
    assert got[0]["values"].index(1.0) == axis and sum(got[0]["values"]) == 1
    assert [g["failure_code"] for g in got] == [None, "input_too_long", "empty_input", "empty_input"]


def test_analysis(spark):
    data = [("a", 10, 8), ("a", 20, 16), ("b", 30, 27), ("b", 40, None)]
    df = spark.createDataFrame(data, '"group" string, planned int, completed int'.replace('"', "`"))
    means = {r["group"]: r for r in rows(A.analyse(df, A.Request("group_mean", "completed", group_by="group")))}
    assert (means["a"]["mean"], means["b"]["count"], means["b"]["missing_count"]) == (12.0, 1, 1)
    r = rows(A.analyse(df, A.Request("pearson_correlation", "planned", "completed")))[0]
    assert r["pearson_correlation"] == pytest.approx(0.9958705949) and (r["paired_count"], r["missing_pair_count"]) == (3, 1)
    assert rows(A.analyse(df, A.Request("row_count", filters=(A.Filter("planned", "greater_than_or_equal", 20),))))[0]["row_count"] == 3
    assert rows(A.analyse(df, A.Request("row_count", filters=(A.Filter("completed", "equals", None),))))[0]["row_count"] == 1
    for bad in (A.Request("row_count", filters=(A.Filter("x", "equals", 1),)), A.Request("describe_numeric", "group"), A.Request("sum"), A.Request("group_mean", "planned"), A.Request("row_count", filters=(A.Filter("group", "less_than", 1),))):
        with pytest.raises(ValueError):
            A.analyse(df, bad)
    with pytest.raises(Exception, match="numeric"):
        A.analyse(df, A.Request("row_count", filters=(A.Filter("completed", "less_than", 10),))).collect()
    one = df.filter("planned = 10")
    assert rows(A.analyse(one, A.Request("pearson_correlation", "planned", "completed")))[0]["error"] == "insufficient_data"
    flat = spark.createDataFrame([(1, 2), (1, 3)], "x int, y int")
    assert rows(A.analyse(flat, A.Request("pearson_correlation", "x", "y")))[0]["error"] == "zero_variance"


def test_penalties(spark):
    full = spark.createDataFrame([({k: 80.0 for k in P.WEIGHTS},)], "m map<string,double>")
    assert rows(full.select(P.weighted_score(F.col("m"), P.WEIGHTS).alias("s")))[0]["s"] == 80.0
    scores = {k: 90.0 for k in P.WEIGHTS if k != "feasibility"}
    df = spark.createDataFrame([(scores, ["direct_duplicate_detected", "official_material_missing"], "all of the world", ["e"], 0.3)], "m map<string,double>, risks array<string>, t string, e array<string>, c double")
    found = P.penalties(P.RankingConfig(), F.col("risks"), F.col("t"), F.col("e"), F.col("c"), F.lit(1), F.lit(False), ["all of the world"], ["foreign"], ["policy"])
    raw = P.weighted_score(F.col("m"), P.WEIGHTS)
    r = rows(df.select(raw.alias("raw"), found.alias("p"), P.penalised(raw, found).alias("s")))[0]
    assert r["raw"] == 81.0 and r["s"] == 81.0 - 20 - 12 - 8 - 10 - 8 - 5
    assert [p["code"] for p in r["p"]] == ["direct_duplicate", "official_material_missing", "scope_too_broad", "insufficient_evidence_ids", "low_confidence", "missing_criterion"]


def test_diversity(spark):
    same = ("d", "c", "o", "h")
    data = [("r", "ai-1", 90.0, *same), ("r", "ai-2", 89.0, *same), ("r", "ai-3", 88.0, *same), ("r", "space", 85.0, "x", "y", "z", None), ("q", "one", 5.0, None, None, None, None)]
    df = spark.createDataFrame(data, "run string, candidate_id string, penalized_score double, domain string, country string, output string, horizon string")
    got = sorted((r for r in rows(P.diversify(df)) if r["run"] == "r"), key=lambda r: r["rank"])
    assert [(r["candidate_id"], r["adjusted_score"]) for r in got] == [("ai-1", 90.0), ("space", 85.0), ("ai-2", 74.0), ("ai-3", 58.0)]


def test_title_duplicates(spark):
    from difflib import SequenceMatcher

    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(4, 60))) for _ in range(40)]
    titles = list(base)
    for t in base:
        for _ in range(2):
            i = rng.randrange(len(t))
            titles.append(t[:i] + rng.choice("abcxyz") + t[i + rng.randint(0, 2) :])
    import re

    canon = [re.sub("[^0-9a-z]+", "", t) for t in titles]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    pairs = G.title_pairs(df, "id", "title")
    got = {(r["a"], r["b"]) for r in rows(pairs)}
    first = {}
    for i, c in enumerate(canon):
        first.setdefault(c, i)
    ids = [i for c, i in first.items() if c]
    want = {(a, b) for a in ids for b in ids if a < b and SequenceMatcher(None, canon[a], canon[b]).ratio() >= 0.92}
    assert got == want
    judged = {r["id"]: (r["kept"], r["duplicate_of"]) for r in rows(G.greedy_dedupe(df.filter(F.col("id").isin(ids)).withColumn("rank", -F.col("id")), pairs, "id", "rank"))}
    kept = []
    for i in sorted(ids, reverse=True):
        near = next((k for k in kept if (min(i, k), max(i, k)) in want), None)
        assert judged[i] == (near is None, near)
        if near is None:
            kept.append(i)


def test_review(spark):
    log = spark.createDataFrame([("r", "a", 1, "hold", 1), ("r", "a", 2, "approve", 2), ("r", "b", 3, "reject", 1)], "run string, c string, sequence long, decision string, at long")
    latest = R.latest_decision(log, ["run", "c"], ["sequence"], ["decision"])
    assert {r["c"]: r["decision"] for r in rows(latest)} == {"a": "approve", "b": "reject"}
    candidates = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "x")], "run string, c string")
    assert {r["run"]: r["status"] for r in rows(R.gate_status(candidates, latest, "run", ["run", "c"]))} == {"r": "ready", "s": "awaiting_review"}
    fault = rows(R.log_faults(log.withColumn("e", F.col("sequence")), "run", "sequence", "at", "e"))[0]
    assert (fault["gaps"], fault["backwards"], fault["repeated_ids"]) == (0, 1, 0)


def test_streams(spark, tmp_path):
    schema = "run_id string, candidate_id string, sequence long, decision string, reviewed_at timestamp"
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [
        [("r", "a", 1, "hold", at(1)), ("r", "a", 2, "approve", at(2))],
        [("r", "b", 4, "reject", at(3)), ("r", "b", 3, "reject", at(1)), ("q", "x", 1, "hold", at(0))],
        [("r", "b", 3, "approve", at(5))],
    ]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    run = L.check_log(stream).writeStream.format("memory").queryName("checked").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["run_id"], r["sequence"], r["decision"]): (r["accepted"], r["reason"]) for r in rows(spark.table("checked"))}
    assert got["r", 1, "hold"] == (True, None) and got["r", 2, "approve"] == (True, None) and got["q", 1, "hold"] == (True, None)
    assert got["r", 3, "reject"] == (False, "earlier_than_last") and got["r", 4, "reject"] == (False, "sequence_gap")
    assert got["r", 3, "approve"] == (True, None)
    run = L.latest_decisions(stream).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r["run_id"], r["candidate_id"]): r["decision"] for r in rows(spark.table("latest"))}["r", "a"] == "approve"


def test_evaluators_are_retried(spark):
    from corvane.operators import issues as I

    calls = {}

    def flaky(text):
        calls[text] = calls.get(text, 0) + 1
        if calls[text] < 2:
            raise TimeoutError
        return 70.0

    def broken(text):
        raise ValueError(text)

    df = spark.createDataFrame([("a", "x"), ("b", "y")], "candidate_id string, text string").coalesce(1)
    got = {(r["candidate_id"], r["criterion"]): (r["score"], r["attempts"], r["failure"]) for r in rows(I.evaluate(df, {"novelty": flaky, "fit": broken}, 3))}
    assert got["a", "novelty"] == (70.0, 2, None) and got["b", "fit"] == (None, 3, "ValueError")


def test_novelty_cap(spark):
    from corvane.operators import issues as I

    candidates = spark.createDataFrame([("c", "Drone Policy Study!", 90.0), ("d", "Other", 10.0)], "candidate_id string, title string, novelty double")
    similar = spark.createDataFrame([("c", 1, "p2", "drone policy study"), ("c", 0, "p1", "nothing alike"), ("d", 0, "p1", "other")], "candidate_id string, pos int, publication_id string, title string")
    got = {r["candidate_id"]: (r["novelty"], r["duplicate_of"]) for r in rows(I.cap_novelty(candidates, similar))}
    assert got == {"c": (20.0, "p2"), "d": (10.0, "p1")}


def test_pdf_pages(spark):
    from corvane.sources.pdf import parse_pdf_pages

    df = spark.createDataFrame([("a", b"%PDF-1.4\n%%EOF"), ("b", b"text")], "path string, content binary")
    got = {r["path"]: r["failure"] for r in rows(parse_pdf_pages(df))}
    assert got["b"] == "invalid_pdf_header" and got["a"] in ("reader_unavailable", "corrupt_structure")


def test_decomposed_text_is_found(spark):
    """NFC and NFD forms of one word, marks that change a letter, and the count of a term in text with other characters."""
    import math
    import unicodedata

    from corvane.operators import search as S
    from corvane.repository import Filters, Publications

    nfd = lambda t: unicodedata.normalize("NFD", t)
    rows = [("a", "국방-국방, 정책", ["김연구"]), ("b", nfd("국방 정책"), [nfd("김연구"), "x"]), ("c", nfd("é è"), ["김", "연구"]), ("d", None, None)]
    docs = spark.createDataFrame(rows, "id string, text string, authors array<string>")
    find = lambda q: {r["id"]: r["score"] for r in S.lexical_search(docs, q, {"content": docs["text"]}, "id", None).collect()}
    idf = math.log(5 / 3) + 1
    assert find(nfd("국방")) == {"a": pytest.approx((1 + math.log(2)) * idf), "b": pytest.approx(idf)}
    assert find("e") == {}
    pubs = docs.selectExpr("id AS publication_id", "'t' AS publication_type", "text AS title", "authors")
    assert {r["publication_id"] for r in Publications(pubs).rows.filter(Filters(authors=["김연구"]).column()).collect()} == {"a", "b"}


def test_places_of_a_sorted_column(spark):
    """Against a sort, with values that very many rows share, nulls, and no rows at all."""
    from corvane.operators import corpus as C

    rng = random.Random(6)
    values = [7] * 400 + [rng.randint(-50, 50) for _ in range(333)] + [None] * 20
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(5)
    known = sorted(v for v in values if v is not None)
    fractions = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {r["fraction"]: r["value"] for r in rows(C.floor_percentiles(df, "v", fractions))}
    assert got == {f: known[int(f * (len(known) - 1))] for f in fractions}
    assert rows(C.floor_percentiles(df.filter("v > 99"), "v", fractions)) == []
    for n in (733, 732, 1):
        part = spark.createDataFrame([(float(v),) for v in known[:n]], "v double")
        found = rows(A.analyse(part, A.Request("describe_numeric", "v")))[0]
        assert found["median"] == (known[:n][(n - 1) // 2] + known[:n][n // 2]) / 2 and found["count"] == n
    assert rows(A.analyse(part.filter("v > 99"), A.Request("describe_numeric", "v")))[0]["median"] is None
