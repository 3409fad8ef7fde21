"""Queries over document files and table functions. The tables hold no files: each document becomes the bytes of one, of the kinds that a tree
holds: JSON, PDF, indexes of other files, and files with faults."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import tables
from corvane.plans.catalogue import register
from corvane.plans.corpus import _FOLD
from corvane.sources import files
from corvane.sources.tables import spread, table

#: By the last digit of the id: 1 cut off, 2 PDF, 3 PDF without header, 4 other, 5 index, 6 not UTF-8, 7 a page number twice.
_EXT = "CASE WHEN doc_id % 10 IN (2, 3) THEN 'pdf' WHEN doc_id % 10 = 4 THEN 'txt' ELSE 'json' END"
_PATH = f"CASE WHEN doc_id % 2 = 0 THEN 'brief' ELSE '연구보고서' END || '/' || doc_id || '.' || {_EXT}"
_TYPE = "CASE WHEN doc_id % 2 = 0 THEN 'kida_brief' ELSE 'research_report' END"


def _json(pages: Column) -> Column:
    name = F.concat(F.floor(F.col("doc_id") / 20).cast("string"), F.lit(".pdf"))
    return F.to_json(F.struct(F.create_map(F.lit("filename"), name).alias("metadata"), F.col("text").alias("full_text"), pages.alias("page_texts")))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = F.col("doc_id") % 10
    lines = F.split("text", "\n", -1)
    page = lambda number: F.transform(lines, lambda t, i: F.struct(number(i).alias("page"), t.alias("text")))
    whole, twice = _json(page(lambda i: i + 1)), _json(page(lambda i: F.greatest(i, F.lit(1))))
    content = (
        F.when(kind == 1, F.substring(whole, F.lit(1), F.length(whole) - 5).cast("binary"))
        .when(kind == 2, F.concat(F.lit("%PDF-1.4 "), "text").cast("binary"))
        .when(kind == 3, F.col("text").cast("binary"))
        .when(kind == 4, F.col("text").cast("binary"))
        .when(kind == 5, F.lit("[1]").cast("binary"))
        .when(kind == 6, F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary")))
        .when(kind == 7, twice.cast("binary"))
        .otherwise(whole.cast("binary"))
    )
    ext = F.when(kind.isin(2, 3), "pdf").when(kind == 4, "txt").otherwise("json")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)
    made = docs.select(
        F.concat(F.when(F.col("doc_id") % 2 == 0, "brief").otherwise("연구보고서"), F.lit("/"), name).alias("path"),
        name.alias("name"),
        F.concat(F.lit("."), ext).alias("suffix"),
        content.alias("content"),
    )
    return made.withColumns({"bytes": F.octet_length("content").cast("long"), "checksum": F.sha2("content", 256)})


@register(
    "file_documents",
    f"""SELECT {_PATH} AS path, CASE WHEN doc_id % 10 IN (2, 3) THEN 'pdf' WHEN doc_id % 10 = 4 THEN 'other' WHEN doc_id % 10 = 5 THEN 'index' ELSE 'json' END AS kind,
  CASE doc_id % 10 WHEN 1 THEN 'corrupt_structure' WHEN 3 THEN 'invalid_pdf_header' WHEN 4 THEN 'unsupported_file_type' WHEN 6 THEN 'decode_error' END AS failure,
  CASE WHEN doc_id % 10 IN (0, 7, 8, 9) THEN sha256(text) END AS body FROM documents""",
)
def file_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file is, and why it cannot be read."""
    read = files.read_documents(_files(spark, sf_dir))
    return read.select("path", "kind", "failure", F.when(F.col("failure").isNull(), F.sha2("content", 256)).alias("body"))


@register(
    "file_pages",
    f"""WITH good AS (SELECT *, string_split(text, chr(10)) AS lines FROM documents WHERE doc_id % 10 IN (0, 7, 8, 9)),
cut AS (SELECT *, CASE WHEN doc_id % 10 = 7 AND len(lines) > 1 THEN lines[3:] ELSE lines END AS kept FROM good)
SELECT {_PATH} AS path, len(list_filter(kept, lambda p: NOT regexp_full_match(p, '\\s*')))::BIGINT AS pages,
  len(list_filter(kept, lambda p: regexp_full_match(p, '\\s*')))::BIGINT AS empty, CASE WHEN doc_id % 10 = 7 AND len(lines) > 1 THEN 1 ELSE 0 END::BIGINT AS corrupt FROM cut""",
)
def file_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every JSON file, and their faults."""
    pages = files.parse_pages(files.read_documents(_files(spark, sf_dir)))
    count = lambda c, name: F.count_if(c).alias(name)
    return pages.groupBy("path").agg(
        count(F.col("failure").isNull(), "pages"), count(F.col("failure") == "empty_page", "empty"), count(F.col("failure") == "corrupt_structure", "corrupt")
    )


@register(
    "file_report",
    """WITH copies AS (SELECT count(*) AS n FROM documents WHERE doc_id % 10 IN (0, 7, 8, 9) GROUP BY doc_id % 2, doc_id // 20 HAVING count(*) > 1)
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE doc_id % 10 IN (0, 2, 7, 8, 9))::BIGINT AS succeeded, count(*) FILTER (WHERE doc_id % 10 IN (1, 3, 4, 6))::BIGINT AS failed,
  count(*) FILTER (WHERE doc_id % 10 = 5)::BIGINT AS skipped, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM copies) AS duplicates, (SELECT count(*)::BIGINT FROM copies) AS duplicate_groups FROM documents""",
)
def file_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.ingestion_report(files.read_documents(_files(spark, sf_dir)))


@register(
    "file_publications",
    f"""WITH f AS (SELECT *, {_PATH} AS path, {_TYPE} AS type FROM documents),
js AS (SELECT type, (doc_id // 20)::VARCHAR AS link, min(path) AS path, count(*)::INT AS n FROM f WHERE doc_id % 10 IN (0, 7, 8, 9) GROUP BY ALL),
pdf AS (SELECT type, text, min(path) AS path, arg_min(doc_id, path)::VARCHAR AS link FROM f WHERE doc_id % 10 = 2 GROUP BY ALL)
SELECT pdf.type AS publication_type, pdf.path AS local_path, pdf.path AS pdf_path, n AS json_files FROM pdf LEFT JOIN js ON pdf.type = js.type AND pdf.link = js.link
UNION ALL SELECT type, path, NULL, n FROM js WHERE NOT EXISTS (SELECT 1 FROM pdf WHERE pdf.type = js.type AND pdf.link = js.link)""",
)
def file_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files with the JSON file of their name, and JSON files alone."""
    found = files.normalise_sources(files.read_documents(_files(spark, sf_dir)))
    number = F.when(F.col("json_paths").isNotNull(), F.size("json_paths"))
    return found.select("publication_type", "local_path", "pdf_path", number.alias("json_files"))


@register(
    "chunk_pages_sql",
    f"""WITH {_FOLD} SELECT doc, chunk::INT AS chunk_index, min(page) AS page_start, max(page) AS page_end, sha256(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS checksum FROM fold GROUP BY doc, chunk""",
)
def chunk_pages_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks made by a table function in SQL."""
    tables.register(spark)
    view = f"turns_{uuid.uuid4().hex}"
    table(spark, sf_dir, "conversations").createOrReplaceTempView(view)
    return spark.sql(f"""
        SELECT doc, chunk_index, page_start, page_end, sha2(text, 256) AS checksum
        FROM chunk_pages(
            TABLE(SELECT conv_id AS doc, CAST(turn + 1 + IF(turn >= 5, 1, 0) AS INT) AS page, IF(turn < 2, 'opening', 'rest') AS section,
                         'reader' AS provenance, text FROM {view}) PARTITION BY (doc) ORDER BY (page), 1500)""")
