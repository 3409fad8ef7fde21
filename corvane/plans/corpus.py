"""Ingestion, quality and chunk queries. The documents hold no Hangul, so the floor on its share is 0 here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import dates as D
from corvane.functions import text as X
from corvane.operators import corpus as C
from corvane.plans.catalogue import register
from corvane.sources.tables import spread, table

LIMITS = C.Thresholds(min_characters=800, min_hangul_ratio=0.0, min_filled_pages=0.5)
_BAD = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{00A0}\x{00AD}\x{061C}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E000}-\x{F8FF}]"
_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"
_LINES = "string_split(text, chr(10))"
_MEASURED = f"""measured AS (SELECT doc_id, lang, source, length(text) AS characters, len({_LINES}) AS pages,
  len(list_filter({_LINES}, lambda p: NOT regexp_full_match(p, '\\s*'))) AS filled_pages,
  length(text) - length(regexp_replace(text, '{_CTRL}', '', 'g')) AS control_characters,
  CASE WHEN length(text) > 0 THEN (length(regexp_replace(text, '{_BAD}', '', 'g')))::DOUBLE / length(text) ELSE 0.0 END AS printable_ratio,
  CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[가-힣]', '', 'g')))::DOUBLE / length(text) ELSE 0.0 END AS hangul_ratio,
  sha256(text) AS checksum FROM documents)"""
_JUDGED = f"""{_MEASURED}, judged AS (SELECT *, CASE WHEN characters < 800 THEN 'low_text'
  WHEN control_characters > 0.01 * characters THEN 'corrupt_text' WHEN printable_ratio < 0.95 THEN 'corrupt_text'
  WHEN filled_pages < 0.5 * pages THEN 'warning' WHEN control_characters > 0 THEN 'warning' ELSE 'ready' END AS first_status FROM measured),
owners AS (SELECT checksum, min(doc_id) AS owner FROM judged WHERE first_status IN ('ready', 'warning') GROUP BY checksum),
verdicts AS (SELECT j.*, CASE WHEN owner < doc_id THEN owner END AS duplicate_of,
  CASE WHEN owner < doc_id THEN 'duplicate' ELSE first_status END AS status FROM judged j LEFT JOIN owners o ON j.checksum = o.checksum)"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.measure(_docs(spark, sf_dir), "text", F.split("text", "\n", -1)).drop("text")


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.judge_duplicates(C.judge(_measured(spark, sf_dir), LIMITS), "doc_id")


@register(
    "quality_measure",
    f"WITH {_MEASURED} SELECT doc_id, characters::INT AS characters, pages::INT AS pages, filled_pages::INT AS filled_pages, control_characters::INT AS control_characters, round(printable_ratio, 6) AS printable_ratio, round(hangul_ratio, 6) AS hangul_ratio, checksum FROM measured",
)
def quality_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir).select(
        "doc_id",
        "characters",
        "pages",
        "filled_pages",
        "control_characters",
        F.round("printable_ratio", 6).alias("printable_ratio"),
        F.round("hangul_ratio", 6).alias("hangul_ratio"),
        "checksum",
    )


@register("quality_verdict", f"WITH {_JUDGED} SELECT doc_id, first_status AS status, first_status IN ('ready', 'warning') AS indexable FROM judged")
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = C.judge(_measured(spark, sf_dir), LIMITS)
    return judged.select("doc_id", "status", F.col("status").isin(*C.INDEXABLE).alias("indexable"))


@register("quality_duplicate_owner", f"WITH {_JUDGED} SELECT doc_id, status, duplicate_of FROM verdicts")
def quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("doc_id", "status", "duplicate_of")


@register(
    "quality_status_counts",
    f"""WITH {_JUDGED}, known AS (SELECT unnest(['ready', 'warning', 'low_text', 'corrupt_text', 'manual_review', 'orphan_pdf', 'duplicate']) AS status)
SELECT k.status, count(v.doc_id)::BIGINT AS n FROM known k LEFT JOIN verdicts v ON k.status = v.status GROUP BY k.status""",
)
def quality_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.status_counts(_verdicts(spark, sf_dir))


@register(
    "quality_rejudge",
    f"WITH {_MEASURED} SELECT doc_id, CASE WHEN characters < 2000 THEN 'low_text' WHEN filled_pages < 0.75 * pages THEN 'warning' ELSE 'ready' END AS status FROM measured",
)
def quality_rejudge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored measurements under other thresholds."""
    stored = _measured(spark, sf_dir)
    limits = C.Thresholds(min_characters=2000, min_hangul_ratio=0.0, min_filled_pages=0.75)
    return C.judge(stored, limits).select("doc_id", "status")


@register(
    "remediation_queue",
    f"""WITH {_JUDGED} SELECT doc_id, status, step::INT AS step, ['reextract', 'ocr'][step + 1] AS action
FROM verdicts, unnest([0, 1]) AS u(step) WHERE status IN ('low_text', 'corrupt_text')""",
)
def remediation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.remediation_queue(_verdicts(spark, sf_dir), "doc_id")


@register(
    "quality_threshold_sweep",
    """SELECT t::DOUBLE AS threshold, lang, count(*) FILTER (WHERE length(text) < t)::BIGINT AS excluded, count(*)::BIGINT AS total
FROM documents, unnest([200, 500, 1000, 2000, 5000]) AS u(t) GROUP BY t, lang""",
)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("lang", F.length("text").alias("characters"))
    return C.threshold_sweep(rows, "characters", [200, 500, 1000, 2000, 5000], "lang")


@register(
    "quality_percentiles",
    """WITH s AS (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) - 1 AS k, count(*) OVER () AS n FROM documents)
SELECT f::DOUBLE AS fraction, v::INT AS value FROM s, unnest([0.0, 0.1, 0.5, 0.9, 0.99, 1.0]) AS u(f) WHERE k = floor(f::DOUBLE * (n - 1))""",
)
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.length("text").alias("characters"))
    return C.floor_percentiles(rows, "characters", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])


@register(
    "codepoint_histogram",
    """WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x00-\\x7F]')) AS c FROM documents)
SELECT unicode(c)::INT AS codepoint, count(DISTINCT doc_id)::BIGINT AS documents, count(*)::BIGINT AS places FROM m GROUP BY c""",
)
def codepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.codepoint_histogram(_docs(spark, sf_dir), "text", r"[^\x00-\x7F]")


@register("ingest_link_left", "SELECT d.doc_id, source, quality, l.doc_id IS NOT NULL AS linked FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def link_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("linked", F.lit(True))
    docs = _docs(spark, sf_dir).select("doc_id", "source")
    joined = C.link_first(docs, labels, ["doc_id"], "quality", ["quality", "linked"])
    return joined.select("doc_id", "source", "quality", F.coalesce("linked", F.lit(False)).alias("linked"))


@register("ingest_unlinked_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlinked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@register(
    "ingest_duplicate_groups",
    "SELECT sha256(text) AS checksum, min(doc_id) AS first_id, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_groups(_docs(spark, sf_dir), "text", "doc_id")


@register(
    "ingest_report",
    """SELECT lang, count(*)::BIGINT AS total, count(*) FILTER (WHERE length(text) >= 800)::BIGINT AS accepted,
  count(*) FILTER (WHERE length(text) < 800)::BIGINT AS rejected, count(DISTINCT source)::BIGINT AS sources FROM documents GROUP BY lang""",
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(
        F.count("*").alias("total"),
        F.count_if(F.length("text") >= 800).alias("accepted"),
        F.count_if(F.length("text") < 800).alias("rejected"),
        F.count_distinct("source").alias("sources"),
    )


@register(
    "missing_field_counts",
    """WITH j AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT 'text' AS field, count(*) FILTER (WHERE text IS NULL OR text = '')::BIGINT AS missing FROM j
UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL OR lang = '')::BIGINT FROM j
UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL)::BIGINT FROM j
UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL)::BIGINT FROM j""",
)
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return C.missing_fields(joined, ["text", "lang", "quality", "toxic"])


@register(
    "publication_type_classify",
    """SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 'report' WHEN source = 'src3' THEN 'journal'
  WHEN contains(lower(split_part(text, chr(10), 1)), 'ist') THEN 'brief'
  WHEN contains(lower(substr(text, 1, 50000)), 'license') THEN 'notice' ELSE 'other' END AS publication_type FROM documents""",
)
def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared type, else a mark in the title, else one in the first 50,000 characters, else other."""
    declared = F.create_map(*[F.lit(x) for x in ("src1", "report", "src2", "report", "src3", "journal")])
    title = F.lower(F.split_part("text", F.lit("\n"), F.lit(1)))
    kind = F.coalesce(
        F.try_element_at(declared, F.col("source")),
        F.when(title.contains("ist"), "brief"),
        F.when(F.lower(F.substring("text", 1, 50_000)).contains("license"), "notice"),
        F.lit("other"),
    )
    return _docs(spark, sf_dir).select("doc_id", kind.alias("publication_type"))


@register(
    "filename_parse",
    """WITH n AS (SELECT o_orderkey, year(o_orderdate)::VARCHAR || '_' || replace(o_orderpriority, '-', '_') || '_' || o_orderstatus || '.pdf' AS name FROM orders)
SELECT o_orderkey, regexp_extract(name, '^(\\d{4})_([^_]+)_(.+)\\.pdf$', 1)::INT AS year, regexp_extract(name, '^(\\d{4})_([^_]+)_(.+)\\.pdf$', 2) AS author,
  regexp_extract(name, '^(\\d{4})_([^_]+)_(.+)\\.pdf$', 3) AS title FROM n""",
)
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", F.year("o_orderdate").cast("string"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")), "o_orderstatus")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(name, F.lit(".pdf")).alias("name"))
    return rows.select("o_orderkey", *C.filename_parts(F.col("name")))


@register(
    "page_explode_validate",
    """WITH p AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS l FROM documents),
q AS (SELECT doc_id, CASE WHEN i % 10 = 0 THEN i - 1 ELSE i END AS page, l[i] AS t FROM p),
v AS (SELECT doc_id, page, length(t) AS n, CASE WHEN count(*) OVER (PARTITION BY doc_id, page) > 1 THEN 'corrupt_structure'
  WHEN regexp_full_match(t, '\\s*') THEN 'empty_page' END AS failure FROM q)
SELECT doc_id, coalesce(failure, 'ok') AS outcome, count(*)::BIGINT AS pages, sum(n)::BIGINT AS characters FROM v GROUP BY 1, 2""",
)
def page_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages; every tenth repeats the number of the one before."""
    numbered = F.transform(
        F.split("text", "\n", -1),
        lambda t, i: F.struct(F.when((i + 1) % 10 == 0, i).otherwise(i + 1).alias("page"), t.alias("text")),
    )
    pages = C.explode_pages(_docs(spark, sf_dir).select("doc_id", numbered.alias("pages")), "doc_id", "pages")
    return pages.groupBy("doc_id", F.coalesce("failure", F.lit("ok")).alias("outcome")).agg(
        F.count("*").alias("pages"), F.sum(F.length("text")).alias("characters")
    )


@register(
    "page_source_select",
    """WITH a AS (SELECT doc_id AS k, string_split(text, chr(10)) AS pages FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT doc_id AS k, string_split(text, chr(10)) AS pages FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN 'pdf' ELSE 'json' END AS source, len(coalesce(a.pages, b.pages))::INT AS n_pages,
  a.pages IS NOT DISTINCT FROM b.pages AS sources_match FROM a FULL JOIN b ON a.k = b.k""",
)
def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("k"), F.split("text", "\n", -1).alias("pages"))
    chosen = C.select_source(rows.filter("k % 3 <> 0"), rows.filter("k % 5 <> 0"), "k")
    return chosen.select("k", "source", F.size("pages").alias("n_pages"), "sources_match")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pages = turns.select(
        F.col("conv_id").alias("doc"),
        (F.col("turn") + 1 + F.when(F.col("turn") >= 5, 1).otherwise(0)).cast("int").alias("page"),
        F.when(F.col("turn") < 2, "opening").otherwise("rest").alias("section"),
        F.lit("reader").alias("provenance"),
        F.col("text"),
    )
    return C.chunk_pages(pages, 1500)


_FOLD = """pages AS (SELECT conv_id AS doc, (turn + 1 + CASE WHEN turn >= 5 THEN 1 ELSE 0 END)::INT AS page,
    CASE WHEN turn < 2 THEN 'opening' ELSE 'rest' END AS section, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
fold AS (
  WITH RECURSIVE r AS (
    SELECT doc, k, page, section, text, 0 AS chunk, length(text) AS size, length(text) >= 1500 AS full_now, section AS sec0, FALSE AS b_sec, FALSE AS b_gap, FALSE AS b_max FROM pages WHERE k = 1
    UNION ALL
    SELECT p.doc, p.k, p.page, p.section, p.text,
      CASE WHEN r.full_now OR p.section <> r.sec0 OR p.page <> r.page + 1 OR r.size + 2 + length(p.text) > 1500 THEN r.chunk + 1 ELSE r.chunk END,
      CASE WHEN r.full_now OR p.section <> r.sec0 OR p.page <> r.page + 1 OR r.size + 2 + length(p.text) > 1500 THEN length(p.text) ELSE r.size + 2 + length(p.text) END,
      CASE WHEN r.full_now OR p.section <> r.sec0 OR p.page <> r.page + 1 OR r.size + 2 + length(p.text) > 1500 THEN length(p.text) ELSE r.size + 2 + length(p.text) END >= 1500,
      CASE WHEN r.full_now OR p.section <> r.sec0 OR p.page <> r.page + 1 OR r.size + 2 + length(p.text) > 1500 THEN p.section ELSE r.sec0 END,
      NOT r.full_now AND p.section <> r.sec0, NOT r.full_now AND p.page <> r.page + 1, NOT r.full_now AND r.size + 2 + length(p.text) > 1500
    FROM r JOIN pages p ON p.doc = r.doc AND p.k = r.k + 1)
  SELECT * FROM r)"""


@register(
    "chunk_pages",
    f"""WITH {_FOLD} SELECT doc, chunk::INT AS chunk_index, min(page) AS page_start, max(page) AS page_end, sha256(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS checksum FROM fold GROUP BY doc, chunk""",
)
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc", "chunk_index", "page_start", "page_end", F.sha2("text", 256).alias("checksum"))


@register(
    "chunk_spans",
    f"""WITH {_FOLD}, s AS (SELECT doc, chunk, page, length(text) + CASE WHEN k < max(k) OVER (PARTITION BY doc, chunk) THEN 2 ELSE 0 END AS n, k FROM fold)
SELECT doc, chunk::INT AS chunk_index, page, (sum(n) OVER (PARTITION BY doc, chunk ORDER BY k) - n)::INT AS start, (sum(n) OVER (PARTITION BY doc, chunk ORDER BY k))::INT AS stop FROM s""",
)
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc", "chunk_index", F.inline("spans"))


@register(
    "chunk_boundary_counts",
    f"""WITH {_FOLD} SELECT 'section-title-change' AS boundary, count(*) FILTER (WHERE b_sec)::BIGINT AS n FROM fold
UNION ALL SELECT 'page-gap', count(*) FILTER (WHERE b_gap)::BIGINT FROM fold
UNION ALL SELECT 'max-characters', (count(*) FILTER (WHERE b_max) + count(*) FILTER (WHERE full_now))::BIGINT FROM fold""",
)
def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = _chunks(spark, sf_dir).select(F.explode("boundaries").alias("boundary"))
    known = spark.createDataFrame([("section-title-change",), ("page-gap",), ("max-characters",)], "boundary string")
    counts = fired.groupBy("boundary").agg(F.count("*").alias("n"))
    return known.join(counts, "boundary", "left").select("boundary", F.coalesce("n", F.lit(0)).alias("n"))


@register(
    "chunk_parser_distribution",
    f"WITH {_FOLD} SELECT 'reader' AS parser, count(DISTINCT doc)::BIGINT AS documents, count(*)::BIGINT AS pages, count(DISTINCT (doc, chunk))::BIGINT AS chunks FROM fold",
)
def chunk_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).groupBy(F.lit("reader").alias("parser")).agg(
        F.count_distinct("doc").alias("documents"), F.sum(F.size("spans")).alias("pages"), F.count("*").alias("chunks")
    )


@register(
    "page_for_offset",
    f"""WITH {_FOLD}, s AS (SELECT doc, chunk, page, k, length(text) + CASE WHEN k < max(k) OVER (PARTITION BY doc, chunk) THEN 2 ELSE 0 END AS n FROM fold),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc, chunk ORDER BY k) AS stop FROM s)
SELECT doc, chunk::INT AS chunk_index, max(page) FILTER (WHERE stop - n <= 700 AND 700 < stop) AS page FROM t GROUP BY doc, chunk""",
)
def page_for_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc", "chunk_index", C.page_of_offset(F.col("spans"), F.lit(700)).alias("page"))


@register(
    "metadata_doi_email_keywords",
    """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::INT AS n_emails,
  nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), '') AS first_email,
  len(regexp_extract_all(text, '10\\.[0-9]{4,9}/[^ \\n]+'))::INT AS n_dois FROM documents""",
)
def metadata_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    email, doi = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"10\.[0-9]{4,9}/[^ \n]+"
    first = F.regexp_extract("text", email, 0)
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.regexp_count("text", F.lit(email)).alias("n_emails"),
        F.when(first != "", first).alias("first_email"),
        F.regexp_count("text", F.lit(doi)).alias("n_dois"),
    )


@register(
    "metadata_evidence_resolve",
    """WITH c AS (SELECT doc_id, lower(split_part(text, ' ', 1)) AS value, 3 AS strength, 0 AS pos FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, lower(split_part(text, ' ', 2)), CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 2 END, 1 FROM documents),
t AS (SELECT doc_id, max(strength) AS strength FROM c GROUP BY doc_id),
s AS (SELECT c.* FROM c JOIN t ON c.doc_id = t.doc_id AND c.strength = t.strength)
SELECT doc_id, strength, CASE WHEN count(DISTINCT replace(value, 'ß', 'ss')) = 1 THEN arg_min(value, pos) END AS value,
  CASE WHEN count(DISTINCT replace(value, 'ß', 'ss')) > 1 THEN 'conflicting_evidence' END AS failure_reason FROM s GROUP BY doc_id, strength""",
)
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    word = lambda n: F.lower(F.split_part("text", F.lit(" "), F.lit(n)))
    cover = docs.filter("doc_id % 2 = 0").select("doc_id", word(1).alias("value"), F.lit(3).alias("strength"), F.lit(0).alias("pos"))
    strength = F.when(F.col("doc_id") % 4 == 0, 3).otherwise(2)
    body = docs.select("doc_id", word(2).alias("value"), strength.alias("strength"), F.lit(1).alias("pos"))
    return C.resolve_evidence(cover.unionByName(body), ["doc_id"])


@register(
    "date_precision_parse",
    """WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 5 AS k FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN d WHEN 1 THEN d WHEN 2 THEN date_trunc('month', d)::DATE WHEN 3 THEN make_date(year(d), 6, 1) ELSE make_date(year(d), 1, 1) END::VARCHAR AS published_at,
  CASE k WHEN 0 THEN 'day' WHEN 1 THEN 'day' WHEN 2 THEN 'month' WHEN 3 THEN 'season' ELSE 'year' END AS precision,
  CASE WHEN k = 3 THEN year(d) || '년 여름(40-2)' END AS issue_label FROM d""",
)
def date_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five ways."""
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    year, month, day = (f(d).cast("string") for f in (F.year, F.month, F.dayofmonth))
    text = (
        F.when(k == 0, F.concat(year, F.lit("년 "), month, F.lit("월 "), day, F.lit("일")))
        .when(k == 1, F.concat_ws(".", year, month, day))
        .when(k == 2, F.concat(year, F.lit("년 "), month, F.lit("월")))
        .when(k == 3, F.concat(year, F.lit("년 여름(40-2)")))
        .otherwise(year)
    )
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", D.parse_partial(text).alias("p")).select("o_orderkey", "p.*")
    return parsed.withColumn("published_at", F.col("published_at").cast("string"))


@register(
    "ocr_adoption",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'provider_failure' WHEN doc_id % 10 < 3 THEN 'below_minimum_confidence'
  WHEN doc_id % 2 = 0 AND length(text) > 200 THEN 'not_better_than_base' WHEN length(text) > 200 THEN 'adopted'
  WHEN length(text) <= 200 THEN 'not_better_than_base' END AS decision FROM documents""",
)
def ocr_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base pages cut to 200 characters, recognised text whole on odd documents and as short on even ones."""
    short = F.substring("text", 1, 200)
    recognised = F.when(F.col("doc_id") % 2 == 0, short).otherwise(F.col("text"))
    confidence = (F.col("doc_id") % 10) / 10.0 + 0.2
    failure = F.when(F.col("doc_id") % 7 == 0, "provider_error")
    decision = C.ocr_decision(short, recognised, confidence, failure)
    return _docs(spark, sf_dir).select("doc_id", decision.alias("decision"))


@register("corpus_digest")
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_digest(_docs(spark, sf_dir), F.col("doc_id").cast("string"), F.col("text"))


@register(
    "text_normalise",
    """SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z가-힣]+', ' ', 'g'))) AS search_sha,
  sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z가-힣]+', '', 'g')) AS canonical_sha FROM documents""",
)
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id",
        F.sha2(X.search_text(F.col("text")), 256).alias("search_sha"),
        F.sha2(X.canonical_text(F.col("text")), 256).alias("canonical_sha"),
    )
