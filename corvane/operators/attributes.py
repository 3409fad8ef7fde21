"""What candidates, signals and publications say about themselves: attributes, aliases, excerpts, checksums, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X

#: The names under which publishers appear, and the one that is kept.
PUBLISHER_ALIASES = {
    "국방부": "대한민국 국방부",
    "국방부(mnd)": "대한민국 국방부",
    "대한민국 국방부": "대한민국 국방부",
    "ministry of national defense": "대한민국 국방부",
    "국회 국방위원회": "대한민국 국회 국방위원회",
    "감사원": "대한민국 감사원",
    "csis": "전략국제문제연구소(CSIS)",
    "center for strategic and international studies": "전략국제문제연구소(CSIS)",
}
#: The names of outputs, and the horizon of each.
OUTPUT_ALIASES = {
    "defense_forum": "defense_forum",
    "kida_brief": "kida_brief",
    "kida brief": "kida_brief",
    "defense_policy_research": "defense_policy_research",
    "정책연구": "defense_policy_research",
    "research_report": "research_report",
}
HORIZONS = {
    "defense_forum": "short_term",
    "kida_brief": "short_term",
    "defense_policy_research": "structural",
    "research_report": "structural",
}
#: What a text must hold to count for a country or, by pattern, for a domain.
COUNTRY_MARKERS = ("대한민국", "한국", "북한", "미국", "중국", "러시아", "일본")
DOMAIN_MARKERS = (("국방인공지능", r"인공지능|(?<![a-z])ai(?![a-z])"), ("무인체계", "드론|무인"))
OFFICIAL = "tier_1_official"
EXCERPT = 4_000


def _named(aliases: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), key)


def publisher_name(value: Column) -> Column:
    """The publisher's kept name, else the name with single spaces."""
    plain = X.collapse_spaces(value)
    return F.coalesce(_named(PUBLISHER_ALIASES, F.lower(plain)), plain)


def output_type(value: Column) -> Column:
    """The output that a name stands for; null if none."""
    return _named(OUTPUT_ALIASES, F.lower(F.trim(value)))


def horizon(output: Column) -> Column:
    return F.coalesce(_named(HORIZONS, output), F.lit("unknown"))


def excerpt(value: Column, most: int = EXCERPT) -> Column:
    """The first characters of a text without white space around it; null if nothing is left."""
    plain = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(plain != "", F.substring(plain, 1, most))


def year_conflict(filename_year: Column, published: Column) -> Column:
    """Whether the year of a file's name is not that of the stated date; no conflict where either is missing."""
    return F.coalesce(filename_year != F.year(published), F.lit(False))


def effective_time(current: Column, new: Column) -> Column:
    """A time that never goes back, whatever a clock says."""
    return F.greatest(current, new)


def publication_order(kind: str = "publication_type", path: str = "local_path", id_col: str = "publication_id") -> list[Column]:
    return [F.col(kind), F.coalesce(F.col(path), F.lit("")), F.col(id_col)]


def _distinct_in_order(signals: DataFrame, labels: str) -> DataFrame:
    """(candidate_id, labels): distinct labels in the order in which they first come, as aggregates."""
    each = signals.select("candidate_id", "pos", F.posexplode(labels).alias("at", "label")).filter("label IS NOT NULL")
    firsts = each.groupBy("candidate_id", "label").agg(F.min(F.struct("pos", "at")).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct("first", "label")))
    return firsts.groupBy("candidate_id").agg(F.transform(listed, lambda x: x["label"]).alias(labels))


def candidate_attributes(candidates: DataFrame, signals: DataFrame) -> DataFrame:
    """(candidate_id, policy_domains, countries, output_type, research_horizon) of candidates (candidate_id, title, question,
    output). Labels are the union of the signals' (candidate_id, pos, policy_domains, countries), in order; a
    candidate without any takes those that its own text marks. Null texts are empty."""
    text = X.fold(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("question", F.lit(""))))
    domains = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in DOMAIN_MARKERS]))
    countries = F.array_compact(F.array(*[F.when(text.contains(m), F.lit(m)) for m in COUNTRY_MARKERS]))
    said = candidates.select("candidate_id", domains.alias("own_domains"), countries.alias("own_countries"), output_type(F.col("output")).alias("output_type"))
    joined = said.join(_distinct_in_order(signals, "policy_domains"), "candidate_id", "left").join(_distinct_in_order(signals, "countries"), "candidate_id", "left")
    return joined.select(
        "candidate_id",
        F.coalesce("policy_domains", "own_domains").alias("policy_domains"),
        F.coalesce("countries", "own_countries").alias("countries"),
        "output_type",
        horizon(F.col("output_type")).alias("research_horizon"),
    )


def without_official_source(signals: DataFrame) -> DataFrame:
    """(candidate_id, unofficial): whether a candidate's external signals name no official source. A signal (candidate_id,
    signal_type, source_ids, reliability_tier) is external by its type or by having sources; candidates without one are not unofficial."""
    external = F.col("signal_type").startswith("external_") | (F.coalesce(F.size("source_ids"), F.lit(0)) > 0)
    official = external & F.col("reliability_tier").eqNullSafe(OFFICIAL)
    found = signals.groupBy("candidate_id").agg(
        F.coalesce(F.bool_or(external), F.lit(False)).alias("external"), F.coalesce(F.bool_or(official), F.lit(False)).alias("official")
    )
    return found.select("candidate_id", (F.col("external") & ~F.col("official")).alias("unofficial"))


def _part(value: Column) -> Column:
    """A part of a hash in hexadecimal: its length in eight bytes, then its bytes."""
    said = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lpad(F.hex(F.octet_length(said)), 16, "0"), F.hex(F.encode(said, "UTF-8")))


def source_checksums(publications: DataFrame, pages: DataFrame) -> DataFrame:
    """(publication_id, source_checksum) of publications (publication_id, publication_type, checksum, path): their own checksum, else the only
    one of their pages (publication_id, page, text, source_checksum), else a hash of identity, file name and pages, each part with its
    length before it. A publication's pages are one value."""
    page = F.concat(_part(F.col("page")), _part(F.col("text")), _part(F.col("source_checksum")))
    held = pages.groupBy("publication_id").agg(
        F.collect_set("source_checksum").alias("sums"), F.array_sort(F.collect_list(F.struct("page", page.alias("part")))).alias("pages")
    )
    name = F.element_at(F.split(F.coalesce("path", F.lit("")), "/"), -1)
    head = F.concat(_part(F.col("publication_id")), _part(F.col("publication_type")), _part(name))
    body = F.coalesce(F.array_join("pages.part", ""), F.lit(""))
    hashed = F.sha2(F.unhex(F.concat(head, body)), 256)
    joined = publications.join(held, "publication_id", "left")
    only = F.when(F.size("sums") == 1, F.col("sums")[0])
    return joined.select("publication_id", F.coalesce("checksum", only, hashed).alias("source_checksum"))
