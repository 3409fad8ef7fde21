"""Document files: PDF and JSON trees, JSON lines, CSV decisions."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.functions import text as X
from corvane.operators.ranking import best_per_group
from corvane.storage import materialise

#: Types by folder, and the marks of a type in names and texts.
FOLDER_TYPES = {
    "brief": "kida_brief",
    "kida brief": "kida_brief",
    "국방논단": "defense_forum",
    "국방정책연구": "defense_policy_research",
    "연구보고서": "research_report",
    "안보전략포커스": "security_strategy_focus",
}
TYPE_MARKS = (
    ("안보전략포커스", "security_strategy_focus"),
    ("kida brief", "kida_brief"),
    ("국방정책연구", "defense_policy_research"),
    ("국방논단", "defense_forum"),
)

DOCUMENT_JSON = T.StructType(
    [
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("full_text", T.StringType()),
        T.StructField("page_texts", T.StringType()),
    ]
)
_PAGES = "path string, page int, text string, failure string"


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``: (path, name, suffix, bytes, checksum, content), without those of the system."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Paths come back as full URIs; what follows the root's own path is kept.
    plain = re.sub(r"^[a-z]+:(//[^/]*)?", "", root).rstrip("/") + "/"
    path = F.substring_index(F.col("path"), plain, -1)
    name = F.element_at(F.split(path, "/"), -1)
    rows = files.select(
        path.alias("path"),
        name.alias("name"),
        F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("checksum"),
        "content",
    )
    return rows.filter((F.col("name") != ".DS_Store") & ~F.col("name").startswith("._"))


def read_documents(files: DataFrame) -> DataFrame:
    """Add kind (pdf, json, index), failure, metadata, content and pages. A file that cannot be read is a row with its
    failure; an index of other files is skipped as such."""
    is_pdf, is_json = F.col("suffix") == ".pdf", F.col("suffix") == ".json"
    text = F.when(is_json & F.is_valid_utf8(F.col("content")), F.decode("content", "UTF-8"))
    parsed = F.from_json(text, DOCUMENT_JSON)
    whole = F.col("j.metadata").isNotNull() & F.col("j.full_text").isNotNull() & F.col("j.page_texts").isNotNull()
    index = text.rlike(r'^\s*(\[|\{\s*"documents"\s*:)')
    header = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    rows = files.withColumns({"__text": text, "j": parsed})
    failure = (
        F.when(is_pdf & ~header, "invalid_pdf_header")
        .when(~is_pdf & ~is_json, "unsupported_file_type")
        .when(is_json & F.col("__text").isNull(), "decode_error")
        .when(is_json & F.coalesce(index, F.lit(False)), F.lit(None).cast("string"))
        .when(is_json & ~F.coalesce(whole, F.lit(False)), "corrupt_structure")
    )
    kind = F.when(is_pdf, "pdf").when(is_json & F.coalesce(index, F.lit(False)), "index").when(is_json, "json").otherwise("other")
    return rows.select(
        "path",
        "name",
        "checksum",
        "bytes",
        kind.alias("kind"),
        failure.alias("failure"),
        F.col("j.metadata").alias("metadata"),
        F.col("j.full_text").alias("content"),
        F.col("j.page_texts").alias("page_json"),
    )


def publication_type(path: Column, category: Column, content: Column) -> Column:
    """By declared category, the deepest folder that names a type, the file name, the first 50,000 characters."""
    alias = F.create_map(*[F.lit(x) for p in FOLDER_TYPES.items() for x in p])
    normal = lambda c: F.trim(F.lower(c))
    parts = F.split(path, "/")
    folders = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    named = F.filter(F.transform(folders, lambda p: F.try_element_at(alias, normal(p))), lambda t: t.isNotNull())

    def marked(c: Column) -> Column:
        found = F.lit(None).cast("string")
        for mark, kind in reversed(TYPE_MARKS):
            found = F.when(normal(c).contains(mark), kind).otherwise(found)
        return found

    return F.coalesce(
        F.try_element_at(alias, normal(category)),
        F.try_element_at(named, F.lit(1)),
        marked(F.element_at(parts, -1)),
        marked(F.substring(content, 1, 50_000)),
        F.lit("other"),
    )


def publication_id(kind: Column, checksum: Column) -> Column:
    parts = F.concat_ws("\x00", F.lit("publication:v1"), kind, checksum)
    return F.concat(F.lit("pub:"), kind, F.lit(":"), F.substring(F.sha2(parts, 256), 1, 32))


def normalise_sources(documents: DataFrame) -> DataFrame:
    """Publications: each PDF with the first JSON, by path, of its type and file name; then JSON without a PDF. Copies
    of a file are one publication, the first by path."""
    key = X.fold(X.nfc(F.coalesce(F.element_at("metadata", "filename"), F.col("name"))))
    typed = documents.filter("failure IS NULL AND kind <> 'index'").withColumns(
        {"publication_type": publication_type(F.col("path"), F.try_element_at("metadata", F.lit("category")), F.col("content"))}
    )
    stem = F.regexp_replace(key, r"\.(pdf|json)$", "")
    keyed = typed.withColumn("link", F.when(F.col("kind") == "pdf", F.regexp_replace(X.fold(X.nfc(F.col("name"))), r"\.pdf$", "")).otherwise(stem))
    # Six branches below read these rows: files are parsed once, and only JSON bodies are kept.
    body = F.when(F.col("kind") == "json", F.col("content")).alias("content")
    keyed = materialise(keyed.select("publication_type", "kind", "link", "path", "name", "checksum", "metadata", body), "sources-keyed")
    js = keyed.filter("kind = 'json'")
    first = best_per_group(js, ["publication_type", "link"], [F.col("path")], ["path", "checksum", "content", "metadata"])
    paths = js.groupBy("publication_type", "link").agg(F.array_sort(F.collect_list("path")).alias("json_paths"))
    linked = first.join(paths, ["publication_type", "link"]).withColumnsRenamed(
        {"path": "json_path", "checksum": "json_checksum", "content": "body", "metadata": "json_metadata"}
    )
    pdf = best_per_group(
        keyed.filter("kind = 'pdf'"), ["publication_type", "checksum"], [F.col("path")], ["path", "link", "name"]
    )
    with_json = pdf.join(linked, ["publication_type", "link"], "left")
    alone = linked.join(pdf.select("publication_type", "link").distinct(), ["publication_type", "link"], "left_anti")
    columns = ["publication_type", "local_path", "pdf_path", "json_paths", "content", "raw_metadata", "checksum"]
    a = with_json.select(
        "publication_type",
        F.col("path").alias("local_path"),
        F.col("path").alias("pdf_path"),
        "json_paths",
        F.col("body").alias("content"),
        F.col("json_metadata").alias("raw_metadata"),
        "checksum",
    )
    b = alone.select(
        "publication_type",
        F.col("json_path").alias("local_path"),
        F.lit(None).cast("string").alias("pdf_path"),
        "json_paths",
        F.col("body").alias("content"),
        F.col("json_metadata").alias("raw_metadata"),
        F.col("json_checksum").alias("checksum"),
    )
    both = a.select(*columns).unionByName(b.select(*columns))
    stems = F.regexp_replace(F.element_at(F.split("local_path", "/"), -1), r"\.[^.]+$", "")
    named = lambda i: F.when(stems.rlike(r"^\d{4}_[^_]+_.+$"), F.regexp_extract(stems, r"^(\d{4})_([^_]+)_(.+)$", i))
    return both.withColumns(
        {
            "publication_id": publication_id(F.col("publication_type"), F.col("checksum")),
            "filename_year": named(1).cast("int"),
            "filename_author": named(2),
            "title": named(3),
        }
    )


def ingestion_report(documents: DataFrame) -> DataFrame:
    """One row: files, successes, failures, skipped, and JSON copies by type and name."""
    done = documents.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("failure").isNull() & (F.col("kind") != "index")).alias("succeeded"),
        F.count_if(F.col("failure").isNotNull()).alias("failed"),
        F.count_if(F.col("kind") == "index").alias("skipped"),
    )
    name = F.coalesce(F.try_element_at("metadata", F.lit("filename")), F.col("name"))
    kind = publication_type(F.col("path"), F.try_element_at("metadata", F.lit("category")), F.col("content"))
    groups = documents.filter("kind = 'json' AND failure IS NULL").groupBy(kind.alias("t"), X.fold(name).alias("k")).agg(F.count("*").alias("n"))
    copies = groups.filter("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("duplicate_groups"))
    return done.crossJoin(copies)  # one row each


def json_pages(raw: str | None) -> list[tuple[int | None, str | None, str | None]]:
    """(page, text, failure) of the pages of a JSON array, in order; faults are rows with their code."""
    try:
        pages = json.loads(raw) if raw is not None else None
    except ValueError:
        pages = None
    if not isinstance(pages, list):
        return [(None, None, "corrupt_structure")]
    if not pages:
        return [(None, None, "empty_document")]
    out: list[tuple[int | None, str | None, str | None]] = []
    good: dict[int, str] = {}
    twice: set[int] = set()
    for p in pages:
        number = p.get("page") if isinstance(p, Mapping) else None
        body = p.get("text") if isinstance(p, Mapping) else None
        if isinstance(number, bool) or not isinstance(number, int) or number < 1 or not isinstance(body, str):
            out.append((None, None, "corrupt_structure"))
        elif number in good or number in twice:
            twice.add(number)
            good.pop(number, None)
        else:
            good[number] = body
    out += [(n, None, "corrupt_structure") for n in sorted(twice)]
    blank = {n for n, body in good.items() if not body.strip()}
    return out + [(n, None, "empty_page") if n in blank else (n, good[n], None) for n in sorted(good)]


def parse_pages(documents: DataFrame) -> DataFrame:
    """Rows (path, page, text, failure) of the pages of JSON documents, in order; faults are rows with their code."""

    def read(batches):
        for batch in batches:
            out = [(path, *row) for path, raw in zip(batch["path"], batch["page_json"], strict=True) for row in json_pages(raw)]
            yield pd.DataFrame(out, columns=["path", "page", "text", "failure"]).astype({"page": "Int32"})

    return documents.filter("kind = 'json' AND failure IS NULL").select("path", "page_json").mapInPandas(read, _PAGES)


def read_index(spark: SparkSession, path: str, schema: str, id_col: str, limit: int | None = None) -> DataFrame:
    """JSON lines whose ids must be unique; with ``limit``, no more rows than this."""
    rows = spark.read.schema(schema).json(path)
    n, kinds = rows.agg(F.count("*"), F.count_distinct(id_col)).first()
    if n != kinds:
        raise ValueError(f"{id_col} values must be unique")
    if limit is not None and n > limit:
        raise ValueError(f"the index has {n} rows; the limit is {limit}")
    return rows


def read_decisions(spark: SparkSession, path: str, schema: str, column: str, known: list[str]) -> DataFrame:
    """CSV rows with a decision; an unknown one fails when read."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    value = F.lower(F.trim(F.col(column)))
    checked = F.when(value.isin(*known), value).otherwise(F.raise_error(F.concat(F.lit("unknown decision: "), value)).cast("string"))
    return rows.filter(value.isNotNull() & (value != "")).withColumn(column, checked)


def read_log(spark: SparkSession, path: str, schema: str, run: str) -> DataFrame:
    """An append-only log whose numbers count from 1 in each run; ``valid`` tells."""
    rows = spark.read.schema(schema).json(path)
    order = Window.partitionBy(run).orderBy("sequence")
    return rows.withColumn("valid", F.col("sequence") == F.row_number().over(order))
