"""Queries on external sources; pages stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import dates as D
from corvane.functions import urls as U
from corvane.operators import attributes as A
from corvane.operators import signals as G
from corvane.operators.ranking import rank_all
from corvane.plans.catalogue import register
from corvane.sources.tables import table

DOMAINS = (
    ("example.org", "government_policy", "tier_1_official"),
    ("example.net", "think_tank_report", "tier_2_institutional"),
    ("blog.tiontion.example.com", "news_article", "tier_3_news"),
)
DEFAULT = ("other", "tier_4_unverified")
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_CANON = f"""lower(regexp_extract(url, '^([a-z]+)://', 1)) || '://' || {_HOST} || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/')
  || CASE WHEN len(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))) > 0
     THEN '?' || array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))), '&') ELSE '' END"""
_SOURCES = f"""sources AS (SELECT page_id, {_CANON} AS url, {_HOST} AS host,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  CASE WHEN page_id % 4 <> 0 THEN DATE '2024-01-01' + (page_id % 200)::INT END AS day FROM pages),
classed AS (SELECT *, CASE WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 'government_policy' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'think_tank_report'
  WHEN host LIKE '%blog.tiontion.example.com' THEN 'news_article' ELSE 'other' END AS source_type,
  CASE WHEN host = 'example.org' OR host LIKE '%.example.org' THEN 0 WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 1 WHEN host LIKE '%blog.tiontion.example.com' THEN 2 ELSE 3 END AS tier_rank FROM sources),
ranked AS (SELECT *, CASE source_type WHEN 'government_policy' THEN 0 WHEN 'think_tank_report' THEN 3 WHEN 'news_article' THEN 4 ELSE 5 END AS type_rank FROM classed)"""
_ORDER = "tier_rank, type_rank, day DESC NULLS LAST, page_id"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(F.col("page_id") % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 200).cast("int"))).alias("day"),
    )
    classed = pages.withColumn("c", G.classify_domain(U.host(F.col("url")), DOMAINS, DEFAULT))
    return classed.select("page_id", U.canonical(F.col("url")).alias("url"), "title", "day", "c.*")


def _order() -> list:
    return G.priority(F.col("tier"), F.col("source_type"), F.col("day"), F.col("page_id"))


@register("url_canonicalize", f"SELECT page_id, {_CANON} AS canonical FROM pages")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical"))


@register(
    "domain_classify",
    f"""WITH {_SOURCES} SELECT page_id, source_type, ['tier_1_official', 'tier_2_institutional', 'tier_3_news', 'tier_4_unverified'][tier_rank + 1] AS tier,
  [0.95::DOUBLE, 0.8::DOUBLE, 0.65::DOUBLE, 0.4::DOUBLE][tier_rank + 1] AS confidence FROM ranked""",
)
def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("page_id", "source_type", "tier", G.confidence(F.col("tier")).alias("confidence"))


@register(
    "domain_allowed",
    f"SELECT page_id, starts_with(url, 'https://') AND ({_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org') AS allowed FROM pages",
)
def domain_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.allowed(F.col("url"), ["example.org"]).alias("allowed"))


@register(
    "source_dedupe_url",
    f"""WITH {_SOURCES}, n AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {_ORDER}) AS k FROM ranked)
SELECT max(page_id) FILTER (WHERE k = 1) AS page_id, url, array_to_string(coalesce(list_sort(list(page_id) FILTER (WHERE k > 1)), []), ',') AS duplicates FROM n GROUP BY url""",
)
def dedupe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.dedupe_urls(_sources(spark, sf_dir), "page_id", _order())
    return found.select("page_id", "url", F.array_join("duplicates", ",").alias("duplicates"))


@register("source_dedupe_title_ratio")
def dedupe_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in priority order, dropped if equal or near to an earlier kept title."""
    return G.dedupe_titles(rank_all(_sources(spark, sf_dir), _order()), "page_id", "title", "rank")


@register("source_priority_order", f"WITH {_SOURCES} SELECT page_id, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM ranked")
def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_all(_sources(spark, sf_dir).drop("url", "title"), _order()).select("page_id", "rank")


@register(
    "signal_from_source",
    f"WITH {_SOURCES} SELECT page_id, 'signal:external:' || substr(sha256('external-signal:v1' || chr(0) || page_id || chr(0) || url), 1, 24) AS signal_id FROM ranked",
)
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).select("page_id", G.signal_id(F.col("page_id"), F.col("url")).alias("signal_id"))


@register(
    "issue_search_all_terms",
    f"""WITH {_SOURCES} SELECT page_id, day::VARCHAR AS day FROM ranked WHERE contains(lower(title || ' ' || url), 'the') AND contains(lower(title || ' ' || url), 'er')
  AND day BETWEEN DATE '2024-02-01' AND DATE '2024-05-31'""",
)
def issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.search_issues(_sources(spark, sf_dir), ["the", "er"], ["title", "url"], "day", "2024-02-01", "2024-05-31")
    return found.select("page_id", F.col("day").cast("string").alias("day"))


@register(
    "lenient_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate::DATE END::VARCHAR AS day FROM orders""",
)
def lenient_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate").cast("string")
    k = F.col("o_orderkey") % 4
    text = (
        F.when(k == 0, F.translate(day, "-", "."))
        .when(k == 1, F.translate(day, "-", "/"))
        .when(k == 2, F.concat(day, F.lit("T08:30:00Z")))
        .otherwise("soon")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", D.lenient_date(text).cast("string").alias("day"))


_PART = "printf('%016X', strlen({0})) || hex({0})"


@register(
    "source_checksums",
    f"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS text, sha256('s' || CASE WHEN conv_id % 3 = 1 THEN 0 ELSE turn END) AS s FROM conversations),
d AS (SELECT conv_id, count(DISTINCT s) AS n, min(s) AS s, string_agg({_PART.format("turn::VARCHAR")} || {_PART.format("text")} || {_PART.format("s")}, '' ORDER BY turn) AS body FROM p GROUP BY conv_id)
SELECT conv_id::VARCHAR AS publication_id, CASE WHEN conv_id % 3 = 0 THEN sha256(conv_id::VARCHAR) WHEN n = 1 THEN s
  ELSE sha256(unhex({_PART.format("conv_id::VARCHAR")} || {_PART.format("'chat'")} || {_PART.format("(conv_id || '.json')")} || body)) END AS source_checksum FROM d""",
)
def source_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as publications: every third has a checksum of its own, every third one for all pages."""
    turns = table(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    own = F.sha2(F.concat(F.lit("s"), F.when(k % 3 == 1, 0).otherwise(F.col("turn")).cast("string")), 256)
    pages = turns.select(k.cast("string").alias("publication_id"), F.col("turn").alias("page"), "text", own.alias("source_checksum"))
    publications = turns.select("conv_id").distinct().select(
        k.cast("string").alias("publication_id"),
        F.lit("chat").alias("publication_type"),
        F.when(k % 3 == 0, F.sha2(k.cast("string"), 256)).alias("checksum"),
        F.concat(F.lit("tree/"), k.cast("string"), F.lit(".json")).alias("path"),
    )
    return A.source_checksums(publications, pages)


@register(
    "candidate_attributes",
    """WITH s AS (SELECT user_id, event_id, event_type AS label FROM events WHERE user_id % 4 <> 0),
f AS (SELECT user_id, label, min(event_id) AS first FROM s GROUP BY ALL), d AS (SELECT user_id, string_agg(label, ',' ORDER BY first) AS domains FROM f GROUP BY user_id),
c AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN ' KIDA Brief ' WHEN 1 THEN 'research_report' ELSE 'other' END AS output FROM events)
SELECT c.user_id AS candidate_id, coalesce(domains, '국방인공지능') AS policy_domains, '미국,일본' AS countries,
  CASE c.user_id % 3 WHEN 0 THEN 'kida_brief' WHEN 1 THEN 'research_report' END AS output_type, CASE c.user_id % 3 WHEN 0 THEN 'short_term' WHEN 1 THEN 'structural' ELSE 'unknown' END AS research_horizon
FROM c LEFT JOIN d ON c.user_id = d.user_id""",
)
def candidate_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as candidates and their events as signals; every fourth candidate has none and is told by its text."""
    events = table(spark, sf_dir, "events")
    output = F.when(F.col("user_id") % 3 == 0, " KIDA Brief ").when(F.col("user_id") % 3 == 1, "research_report").otherwise("other")
    candidates = events.select(
        F.col("user_id").alias("candidate_id"), F.lit("AI of 미국").alias("title"), F.lit("said in 일본").alias("question"), output.alias("output")
    ).distinct()
    signals = events.filter("user_id % 4 <> 0").select(
        F.col("user_id").alias("candidate_id"), F.col("event_id").alias("pos"), F.array("event_type").alias("policy_domains"), F.array().cast("array<string>").alias("countries")
    )
    made = A.candidate_attributes(candidates, signals)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return made.select("candidate_id", joined("policy_domains"), joined("countries"), "output_type", "research_horizon")
