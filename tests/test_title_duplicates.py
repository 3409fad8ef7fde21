"""Greedy title duplicates against the plain walk over a list."""

from __future__ import annotations

import random
import re
import unicodedata
from difflib import SequenceMatcher

from corvane.operators import signals as G
from corvane.plans import catalogue


def walk(sources, least=0.92):
    """The rule as it is said: sources (rank, id, title) one after the other, each against all that were kept."""
    kept, out = [], {}
    for _, i, title in sorted(sources, key=lambda s: s[:2]):
        t = re.sub("[^0-9a-z가-힣]+", "", unicodedata.normalize("NFC", title or "").casefold())
        out[i] = next((k for k, kt in kept if t and kt and SequenceMatcher(None, t, kt).ratio() >= least), None)
        if out[i] is None:
            kept.append((i, t))
    return {(i, o is None, o) for i, o in out.items()}


def of_query(spark, path):
    """What the query and the walk say of the pages of ``path``."""
    asked = catalogue.queries()
    titles = {r.page_id: re.search("<title>([^<]*)</title>", r.html or "") for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    ranks = {r.page_id: r["rank"] for r in asked["source_priority_order"](spark, path).collect()}
    got = [tuple(r) for r in asked["source_dedupe_title_ratio"](spark, path).collect()]
    assert len(got) == len(titles)
    return set(got), walk((ranks[i], i, t and t[1]) for i, t in titles.items())


def test_given_pages(spark):
    """Most duplicates among the pages have equal titles."""
    got, want = of_query(spark, "/root/testdata/sf0.001")
    assert got == want and len({o for _, _, o in want if o is not None}) > 1


def test_odd_titles(spark, tmp_path):
    rng = random.Random(7)
    titles = ["Same title", "same  TITLE!", "sametitle", "", "", " - ", None, "문서 제목의 첫째 판", unicodedata.normalize("NFD", "문서 제목의 첫째 판"), "ﬁne oﬃce ﬆaff", "fine office staff"]
    titles += ["Café résumé of the naïve", unicodedata.normalize("NFD", "Café résumé of the naïve"), "Straße nach Gießen", "STRASSE NACH GIESSEN"]
    # Near in one order only.
    for a, b in (("caaacccaaabacbbacbaacbabbcacbbab", "caaacccaaacbcbaacbaacbabbccacbbab"), ("cbbabababcccabbcababcbba", "cbbabababcccabbcaabaabbba")):
        titles += [a, b, a.translate(str.maketrans("abc", "xyz")), b.translate(str.maketrans("abc", "xyz"))][:: rng.choice([1, -1])]
    for n in (6, 40, 70, 90, 250):
        # A chain: each near the one before it, the ends far from each other; some of them again.
        t = "".join(rng.choice("abcdefgh ") for _ in range(n))
        for _ in range(6):
            titles += [t] * rng.randint(1, 3)
            at = rng.randrange(n - 2)
            t = t[:at] + rng.choice("xyz") + t[at + rng.randint(0, 2) :]
    rng.shuffle(titles)
    hosts = ["example.org", "example.net", "other.com"]
    page = lambda i, t: (i, f"https://{rng.choice(hosts)}/{i}", None if t is None else f"<html><title>{t}</title></html>")
    pages = [page(i, t) for i, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got, want = of_query(spark, str(tmp_path))
    assert got == want


def test_no_titles(spark):
    assert G.dedupe_titles(spark.createDataFrame([], "id long, title string, rank int"), "id", "title", "rank").collect() == []


def test_pairs_of_the_first_of_equal_titles(spark):
    data = [(1, "A title of some length", 3), (2, "a title of some length!", 1), (3, "a title of some lengths", 2), (4, "far", 4)]
    pairs = G.title_pairs(spark.createDataFrame(data, "id long, title string, rank int"), "id", "title", rank="rank")
    assert [(r.a, r.b) for r in pairs.collect()] == [(2, 3)]
