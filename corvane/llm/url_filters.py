"""URL filters: host and path rules, then a list of canonical URLs.

A blocked Bloom filter of the listed canonical URLs (one 256-bit block per URL, two bits in each of
its four words) is a table of at most ``max_blocks`` rows, whatever the length of the list: a proven
bound, so it is broadcast. Rows that it passes are possible hits; only those go to an exact hash join
with the list, which removes false positives. A list too long for the bound passes more false
positives, with the same final result.

Edge cases: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed.
Repeated rows are judged alike. An empty list blocks nothing. Extra columns pass through, those that clash with the
four that are added (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blocks of the filter: 42 MB. Some 16 million listed URLs fill it to 16 bits each; a longer list passes more false hits.
MAX_BLOCKS = 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict) of the production rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Domains whose pages make up the production list.
LISTED_DOMAINS = ("spam-farm.example.org", "casino-win.example.net", "adult-x.example.com")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and a default port, path without closing slashes, and the query's parameters
    sorted, those for tracking left out. Scheme and fragment do not count. Null without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^utm_|^(fbclid|gclid)=") & (p != "")))
    return F.when(
        _rest(url).isNotNull(),
        F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")),
    )


def fits_domain(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, a longer host first among equals; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for domain, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        this = F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits_domain(host, domain) & path.startswith(prefix), this).otherwise(found)
    return found


def _bits(canonical: Column) -> list[Column]:
    """Masks of the two bits in each of the four words of a URL's block."""
    h = F.xxhash64(canonical, F.lit(1))
    one = lambda at: F.call_function(
        "shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int")
    )
    return [one(12 * i).bitwiseOR(one(12 * i + 6)).alias(f"__m{i}") for i in range(4)]


def bloom_blocks(n_listed: int, max_blocks: int) -> int:
    """Blocks for 16 bits a URL, a power of two, at least 64 and at most ``max_blocks``."""
    return min(max_blocks, 1 << max(6, (max(n_listed, 1) // 16).bit_length()))


def listed_rows(
    rows: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS, key: str = "canonical", out: str = "listed"
) -> DataFrame:
    """Add boolean ``out``: whether the row's ``key`` is in ``listed.canonical``."""
    listed = listed.select(F.col("canonical").alias("__listed_url")).filter("__listed_url IS NOT NULL").distinct()
    n_blocks = bloom_blocks(listed.count(), max_blocks)
    block = lambda url: F.xxhash64(url).bitwiseAND(F.lit(n_blocks - 1))
    words = [f"__m{i}" for i in range(4)]
    bloom = (
        listed.select(block(F.col("__listed_url")).alias("__b"), *_bits(F.col("__listed_url")))
        .groupBy("__b")
        .agg(*[F.bit_or(w).alias(w.replace("m", "f")) for w in words])
    )
    kept = [F.col(f"`{c}`") for c in rows.columns]
    url = F.col(f"`{key}`")
    probes = rows.select(*kept, F.when(url.isNotNull(), block(url)).alias("__block"), *_bits(url))
    held = probes.join(F.broadcast(bloom), F.col("__block") == F.col("__b"), "left")
    possible = F.coalesce(
        F.col("__f0").isNotNull()
        & (F.col("__f0").bitwiseAND(F.col("__m0")) == F.col("__m0"))
        & (F.col("__f1").bitwiseAND(F.col("__m1")) == F.col("__m1"))
        & (F.col("__f2").bitwiseAND(F.col("__m2")) == F.col("__m2"))
        & (F.col("__f3").bitwiseAND(F.col("__m3")) == F.col("__m3")),
        F.lit(False),
    )
    tested = held.select(*kept, possible.alias("__possible"))
    passed = tested.filter("__possible").drop("__possible")
    hits = passed.join(listed, url == F.col("__listed_url"), "left").select(
        *kept, F.col("__listed_url").isNotNull().alias(out)
    )
    clear = tested.filter("NOT __possible").select(*kept, F.lit(False).alias(out))
    return clear.unionByName(hits)


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url"
) -> DataFrame:
    """Columns of ``pages`` with host, path, rule and verdict (allow or block)."""
    added = ("host", "path", "rule", "verdict")
    said = F.col(f"`{url}`")
    rows = pages.withColumns({"__host": host_of(said), "__path": path_of(said), "__canonical": canonical_url(said)})
    ruled = rows.withColumn("__ruled", longest_rule(F.col("__host"), F.col("__path"), rules))
    judged = listed_rows(ruled, listed, key="__canonical", out="__listed")
    verdict = F.coalesce(F.col("__ruled.verdict"), F.when(F.col("__listed"), "block").otherwise("allow"))
    return judged.select(
        *[F.col(f"`{c}`") for c in pages.columns if c == url or c not in added],
        *[F.col(c).alias(name) for c, name in (("__host", "host"), ("__path", "path")) if name != url],
        F.col("__ruled.rule").alias("rule"),
        verdict.alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page. The list holds the canonical URLs of all pages on three listed
    domains, standing in for a published list."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    host = host_of(F.col("url"))
    on_list = F.lit(False)
    for domain in LISTED_DOMAINS:
        on_list = on_list | fits_domain(host, domain)
    listed = pages.filter(on_list).select(canonical_url(F.col("url")).alias("canonical"))
    return judge_urls(pages, listed).drop("url")


ORACLE_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages),
parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(r, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '(^|\.)(spam-farm\.example\.org|casino-win\.example\.net|adult-x\.example\.com)$') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
