"""Incremental corpus builds: from source documents to admitted chunks.

A build parses, measures, judges and chunks the documents whose checksum it has not seen under the same settings; all others keep
what an earlier build made of them. It is addressed by content: a document's row holds its checksum, the settings' digest and the
part that holds its chunks, so an anti-join tells what is new. Verdicts that depend on other documents (who owns a body) are
made anew from the rows of all documents, which hold no text.

The digest of the sources is taken before and after; a difference aborts the build. Nothing that a build writes is seen
before its version is published, and of two builds that began with the same version one fails.

Layout below the root: ``parts/<part>`` chunks, written once; ``v-*/documents`` one row a document; ``v-*/manifest`` one row.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import corpus as C
from corvane.sources import sinks
from corvane.sources.versions import Version, Versions
from corvane.storage import discard, materialise, scratch_scope

#: What a manifest answers for.
ADDRESSED = ["doc", "source_checksum", "status", "duplicate_of", "n_chunks", "chunks_sha256"]


class SourceChanged(RuntimeError):
    """The sources are not what they were when the build began."""


@dataclass(frozen=True)
class Settings:
    """Whatever changes what is made of a document."""

    thresholds: C.Thresholds = field(default_factory=C.Thresholds)
    max_characters: int = 4000
    parser: str = "json-pages"
    version: str = "1"

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


@dataclass(frozen=True)
class Build:
    """A published build."""

    spark: SparkSession
    root: str
    version: Version

    @property
    def documents(self) -> DataFrame:
        """One row a document: checksums, measurements, verdict, number and digest of its chunks, and their part."""
        return self.spark.read.parquet(f"{self.version.path}/documents")

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.version.path}/manifest")

    @property
    def chunks(self) -> DataFrame:
        """The chunks of all admitted documents."""
        live = self.documents.filter(F.col("status").isin(*C.INDEXABLE) & (F.col("n_chunks") > 0)).select("doc", "part")
        parts = [r.part for r in live.select("part").distinct().collect()]  # one for each build that still counts
        if not parts:
            return self.spark.read.parquet(f"{self.root}/parts/{self.version.about['part']}").limit(0)
        stored = self.spark.read.parquet(*[f"{self.root}/parts/{p}" for p in parts])
        return stored.join(live, ["doc", "part"], "left_semi")


def source_digest(sources: DataFrame) -> str:
    """One hash of (doc, source_checksum) of all sources."""
    return C.corpus_digest(sources, F.col("doc").cast("string"), F.col("source_checksum")).first()["digest"]


def _made(spark: SparkSession, fresh: DataFrame, parse: Callable, settings: Settings, root: str, part: str) -> DataFrame:
    """Rows of new documents; their chunks are written to ``part``."""
    parsed = materialise(parse(fresh), "build-parsed")
    texts = F.transform("pages", lambda p: F.coalesce(p["text"], F.lit("")))
    bodies = parsed.withColumns({"__texts": texts, "__body": F.array_join(texts, "\n")})
    measured = C.measure(bodies, "__body", F.col("__texts")).drop("__texts", "__body")
    judged = materialise(C.judge(measured, settings.thresholds, F.col("orphan"), F.col("risky_name")), "build-judged")
    admitted = judged.filter(F.col("status").isin(*C.INDEXABLE)).select("doc")
    pages = parsed.join(admitted, "doc", "left_semi").select("doc", F.inline("pages")).withColumn("provenance", F.lit(settings.parser))
    chunks = C.chunk_pages(pages.select("doc", "page", "section", "provenance", "text"), settings.max_characters)
    path = f"{root}/parts/{part}"
    chunks.withColumns({"part": F.lit(part), "checksum": F.sha2("text", 256)}).write.parquet(path)
    each = F.sha2(F.to_json(F.struct("chunk_index", "page_start", "page_end", "section", "checksum")), 256)
    stored = spark.read.parquet(path).groupBy("doc").agg(
        F.count("*").alias("n_chunks"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", each.alias("h")))), lambda s: s["h"]), ""), 256).alias("chunks_sha256"),
    )
    counted = judged.join(stored, "doc", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    return counted.withColumns({"settings": F.lit(settings.digest), "part": F.lit(part)})


def build_corpus(
    sources: Callable[[], DataFrame], parse: Callable[[DataFrame], DataFrame], spark: SparkSession, root: str, settings: Settings | None = None
) -> Build:
    """Build what is new and publish the next version.

    ``sources()`` reads (doc, source_checksum, ...) afresh; doc is unique and not null. ``parse`` turns such rows into (doc, source_checksum, orphan,
    risky_name, pages), pages an array of (page, section, text). A document without pages is judged on an empty text. Null section titles
    are equal to each other. No sources give a build without documents.
    """
    settings = settings or Settings()
    root, part = root.rstrip("/"), f"part-{uuid.uuid4().hex}"
    versions = Versions(spark, root)
    seen = versions.current()
    with scratch_scope(spark):
        before = source_digest(sources())
        rows = sources()
        listing = rows.select("doc", "source_checksum", F.lit(settings.digest).alias("settings"))
        key = ["doc", "source_checksum", "settings"]
        own = ["status", "duplicate_of"]
        old = spark.read.parquet(f"{seen.path}/documents") if seen else None
        fresh = rows if old is None else rows.withColumn("settings", F.lit(settings.digest)).join(old.select(*key), key, "left_anti").drop("settings")
        made = _made(spark, fresh, parse, settings, root, part).withColumnRenamed("status", "own_status")
        if old is not None:
            made = made.unionByName(old.drop(*own).join(listing, key, "left_semi"))
        path = versions.fresh()
        judged = C.judge_duplicates(made.withColumn("status", F.col("own_status")), "doc")
        judged.write.parquet(f"{path}/documents")
        stored = spark.read.parquet(f"{path}/documents")
        sinks.manifest(stored, ADDRESSED, settings=settings.digest).write.parquet(f"{path}/manifest")
        after = source_digest(sources())
    if before != after:
        discard(spark, path)
        discard(spark, f"{root}/parts/{part}")
        raise SourceChanged(f"the sources changed during the build: {before} -> {after}")
    return Build(spark, root, versions.publish(path, seen, part=part, source_digest=after))


def open_build(spark: SparkSession, root: str) -> Build:
    version = Versions(spark, root).current()
    if version is None:
        raise FileNotFoundError(f"{root} has no build")
    return Build(spark, root.rstrip("/"), version)


def summary(build: Build) -> DataFrame:
    """One row: documents, those admitted, their chunks, and how many documents each status has."""
    admitted = F.col("status").isin(*C.INDEXABLE)
    counts = [F.count_if(F.col("status") == s).alias(s) for s in C.STATUSES]
    return build.documents.agg(
        F.count("*").alias("documents"),
        F.count_if(admitted).alias("admitted"),
        F.coalesce(F.sum(F.when(admitted, F.col("n_chunks"))), F.lit(0)).alias("chunks"),
        *counts,
    )


def file_sources(spark: SparkSession, root: str) -> DataFrame:
    """Sources for :func:`build_corpus` from a tree of PDF and JSON files: one row a publication."""
    from corvane.sources import files

    publications = files.normalise_sources(files.read_documents(files.scan_files(spark, root)))
    return publications.select(
        F.col("publication_id").alias("doc"),
        # A publication is what its files and their names say: a changed JSON beside the same PDF is a change.
        F.sha2(F.concat_ws("\x00", "checksum", "local_path", F.array_join("json_paths", "\x00"), F.sha2(F.coalesce("content", F.lit("")), 256)), 256).alias("source_checksum"),
        "local_path",
        "pdf_path",
        F.try_element_at("json_paths", F.lit(1)).alias("json_path"),
    )


def file_parser(spark: SparkSession, root: str) -> Callable[[DataFrame], DataFrame]:
    """The parser of :func:`file_sources`' rows: the pages of the first JSON file of each. A fault that is not an empty page
    makes the build fail; a PDF without JSON is an orphan without pages."""
    from corvane.sources import files

    def parse(fresh: DataFrame) -> DataFrame:
        paths = fresh.select(F.col("json_path").alias("path")).filter("path IS NOT NULL").distinct()
        documents = files.read_documents(files.scan_files(spark, root)).join(paths, "path", "left_semi")
        pages = files.parse_pages(documents)
        bad = F.col("failure").isNotNull() & (F.col("failure") != "empty_page")
        told = F.raise_error(F.concat(F.lit("unexpected parser failure for "), "path", F.lit(": "), "failure"))
        checked = pages.withColumn("text", F.when(bad, told.cast("string")).otherwise(F.coalesce("text", F.lit(""))))
        page = F.struct("page", F.lit(None).cast("string").alias("section"), "text")
        held = checked.groupBy("path").agg(F.array_sort(F.collect_list(page)).alias("pages"))
        name = F.element_at(F.split("local_path", "/"), -1)
        return fresh.join(held.withColumnRenamed("path", "json_path"), "json_path", "left").select(
            "doc",
            "source_checksum",
            (F.col("pdf_path").isNotNull() & F.col("json_path").isNull()).alias("orphan"),
            C.title_cut_off(name).alias("risky_name"),
            F.coalesce("pages", F.array().cast("array<struct<page:int,section:string,text:string>>")).alias("pages"),
        )

    return parse
