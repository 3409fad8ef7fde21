"""A stored vector index over chunks: checked when it is built, verified before it is read.

Layout of a version: ``entries`` (position, chunk_id, publication_id, chunk_index, checksum, values), sorted into files by position;
``skipped`` chunks with the code of their failure; ``files`` with size and SHA-256 of each file of entries; ``manifest.json``.

Build rules, each an error: chunk ids, and publications with chunk numbers, are unique; every chunk has the configured chunking
version and the checksum of its text; every chunk has either a vector or a failure; a failure other than of an empty or too
long input aborts; a vector has the provider's dimension, finite values and a length that is not zero.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import search as S
from corvane.operators.ranking import rank_all
from corvane.sources.verified import observed
from corvane.sources.versions import Version, Versions, names, read_text, write_text
from corvane.storage import materialise, scratch_scope

#: Failures that only the text is to blame for: such chunks are left out and counted.
SKIPPABLE = ("empty_input", "input_too_long")
SETTINGS = ("embedding_model_id", "embedding_version", "dimension", "normalization", "chunking_version")


class IndexBuildError(ValueError):
    """The chunks or their vectors break a rule."""


class IndexMismatch(ValueError):
    """The index is not the one that the reader expects, or not the one that was written."""


@dataclass(frozen=True)
class Provider:
    """Embeds texts by an expression: a struct of ``values`` and ``failure_code``, one of which is null."""

    embedding_model_id: str
    embedding_version: str
    dimension: int
    embed: Callable[[Column], Column]
    normalized: bool = True

    @property
    def settings(self) -> dict:
        return {
            "embedding_model_id": self.embedding_model_id,
            "embedding_version": self.embedding_version,
            "dimension": self.dimension,
            "normalization": "l2" if self.normalized else "none",
        }


def hash_axis_provider(dimension: int = 8, max_bytes: int = 8192) -> Provider:
    return Provider("hash-axis", "1", dimension, lambda text: S.hash_axis_embedding(text, dimension, max_bytes))


def chunk_faults(chunks: DataFrame, chunking_version: str) -> DataFrame:
    """(fault, chunk_id) of all chunks that break a rule. ``chunks`` has (chunk_id, publication_id, chunk_index,
    checksum, chunking_version, text)."""
    own = F.filter(
        F.array(
            F.when(F.col("chunk_id").isNull() | F.col("publication_id").isNull() | F.col("chunk_index").isNull(), "missing_identity"),
            F.when(~F.col("chunking_version").eqNullSafe(chunking_version), "version_mismatch"),
            F.when(~F.col("checksum").eqNullSafe(F.sha2(F.coalesce("text", F.lit("")), 256)), "checksum_mismatch"),
        ),
        lambda f: f.isNotNull(),
    )
    single = chunks.select(F.explode(own).alias("fault"), "chunk_id")
    repeated = lambda keys, fault: (
        chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first")).filter("n > 1").select(F.lit(fault).alias("fault"), F.col("first").alias("chunk_id"))
    )
    return single.union(repeated(["chunk_id"], "repeated_chunk_id")).union(repeated(["publication_id", "chunk_index"], "repeated_position"))


def vector_faults(embedded: DataFrame, dimension: int) -> DataFrame:
    """(fault, chunk_id) of chunks whose ``values`` or ``failure_code`` cannot be stored."""
    v = F.col("values")
    fault = (
        F.when(v.isNull() & F.col("failure_code").isNull(), "no_outcome")
        .when(v.isNotNull() & F.col("failure_code").isNotNull(), "two_outcomes")
        .when(F.col("failure_code").isNotNull() & ~F.col("failure_code").isin(*SKIPPABLE), F.concat(F.lit("failed: "), "failure_code"))
        .when(v.isNotNull() & (F.size(v) != dimension), "wrong_dimension")
        .when(v.isNotNull() & F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(v.isNotNull() & ~F.exists(v, lambda x: x != 0), "zero_norm")
    )
    return embedded.select(fault.alias("fault"), "chunk_id").filter("fault IS NOT NULL")


def _require(faults: DataFrame) -> None:
    found = faults.groupBy("fault").agg(F.count("*").alias("n"), F.min("chunk_id").alias("chunk_id")).orderBy("fault").collect()
    if found:
        raise IndexBuildError("; ".join(f"{r.fault}: {r.n}, first {r.chunk_id}" for r in found[:20]))


def _file_sums(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def build_index(chunks: DataFrame, root: str, provider: Provider, chunking_version: str, max_records: int = 200_000) -> Version:
    """Check, embed and store chunks as the next version of the index at ``root``."""
    spark = chunks.sparkSession
    if not chunking_version.strip():
        raise IndexBuildError("chunking_version must not be blank")
    if isinstance(provider.dimension, bool) or provider.dimension <= 0:
        raise IndexBuildError("the provider's dimension must be positive")
    versions = Versions(spark, root)
    seen, path = versions.current(), versions.fresh()
    with scratch_scope(spark):
        columns = ["chunk_id", "publication_id", "chunk_index", "checksum"]
        _require(chunk_faults(chunks, chunking_version))
        size = F.octet_length(F.coalesce("text", F.lit(""))).alias("input_bytes")
        embedded = chunks.select(*columns, size, provider.embed(F.col("text")).alias("e")).select(*columns, "input_bytes", "e.values", "e.failure_code")
        embedded = materialise(embedded, "index-embedded")
        _require(vector_faults(embedded, provider.dimension))
        order = [F.col("publication_id"), F.col("chunk_index"), F.col("chunk_id")]
        ranked = rank_all(embedded.filter("failure_code IS NULL").drop("failure_code", "input_bytes"), order, "position")
        placed = ranked.repartitionByRange("position").sortWithinPartitions("position")
        _, figures = observed(placed, lambda rows: rows.write.option("maxRecordsPerFile", max_records).parquet(f"{path}/entries"))
        skipped = embedded.filter("failure_code IS NOT NULL").drop("values")
        skipped.write.parquet(f"{path}/skipped")
        counts = embedded.agg(F.count("*").alias("n"), F.count("failure_code").alias("skipped")).first()
    if figures["rows"] + counts["skipped"] != counts["n"]:
        raise IndexBuildError(f"{counts['n']} chunks became {figures['rows']} entries and {counts['skipped']} skipped ones")
    _file_sums(spark, f"{path}/entries").write.parquet(f"{path}/files")
    manifest = {
        **provider.settings,
        "chunking_version": chunking_version.strip(),
        "input_chunks": counts["n"],
        "indexed_chunks": figures["rows"],
        "skipped_chunks": counts["skipped"],
        "entries": figures,
        "similarity": "cosine",
        "order": ["score descending", "publication_id", "chunk_index", "chunk_id"],
    }
    manifest["content_address"] = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    return versions.publish(path, seen, content_address=manifest["content_address"])


@dataclass(frozen=True)
class VectorIndex:
    """A verified index."""

    spark: SparkSession
    path: str
    manifest: dict

    @property
    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries")

    @property
    def skipped(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/skipped")

    def search(self, query: str, provider: Provider, limit: int, allowed: DataFrame | None = None) -> DataFrame:
        """(publication_id, chunk_index, chunk_id, checksum, score), best first. Settings are compared before anything is embedded.
        ``allowed`` (publication_id) restricts what is ranked. A blank query or a limit of 0 finds nothing."""
        _same(self.manifest, provider.settings)
        columns = ["publication_id", "chunk_index", "chunk_id", "checksum"]
        if limit <= 0 or not query.strip():
            return self.entries.select(*columns, F.lit(0.0).alias("score")).limit(0)
        row = self.spark.createDataFrame([(query,)], "text string").select(provider.embed(F.col("text")).alias("e")).first()["e"]
        if row["failure_code"] is not None or row["values"] is None:
            raise IndexMismatch(f"the query cannot be embedded: {row['failure_code']}")
        values = list(row["values"])
        if len(values) != self.manifest["dimension"] or not all(math.isfinite(v) for v in values) or not any(values):
            raise IndexMismatch("the query's vector is not one of the index")
        rows = self.entries if allowed is None else self.entries.join(allowed.select("publication_id"), "publication_id", "left_semi")
        return S.nearest(rows.select(*columns, "values"), values, "values", columns[:3], limit)


def _same(manifest: dict, expected: dict) -> None:
    different = [f"{k}: {manifest.get(k)!r}, expected {v!r}" for k, v in expected.items() if manifest.get(k) != v]
    if different:
        raise IndexMismatch("; ".join(different))


def open_index(spark: SparkSession, root: str, provider: Provider, chunking_version: str, verify_files: bool = True) -> VectorIndex:
    """The current index, if its five settings are the expected ones, its manifest is whole, and its files are those
    that were written. Files are compared by size, and with ``verify_files`` by checksum, each in the task that reads it."""
    version = Versions(spark, root).current()
    if version is None:
        raise IndexMismatch(f"{root} has no index")
    manifest = json.loads(read_text(spark, f"{version.path}/manifest.json"))
    _same(manifest, provider.settings | {"chunking_version": chunking_version.strip()})
    unsigned = {k: v for k, v in manifest.items() if k != "content_address"}
    address = hashlib.sha256(json.dumps(unsigned, sort_keys=True).encode()).hexdigest()
    if address != manifest.get("content_address") or address != version.about.get("content_address"):
        raise IndexMismatch("the manifest is not the one that was published")
    stored = spark.read.parquet(f"{version.path}/files")
    if verify_files:
        now = _file_sums(spark, f"{version.path}/entries")
        wrong = stored.join(now.withColumnsRenamed({"bytes": "b", "sha256": "s"}), "name", "full_outer").filter(
            ~F.col("bytes").eqNullSafe(F.col("b")) | ~F.col("sha256").eqNullSafe(F.col("s"))
        )
        bad = [r.name for r in wrong.select("name").limit(5).collect()]
    else:
        here = {n: b for n, b in names(spark, f"{version.path}/entries") if n.endswith(".parquet")}
        there = {r.name: r.bytes for r in stored.select("name", "bytes").collect()}
        bad = sorted(n for n in here.keys() | there.keys() if here.get(n) != there.get(n))[:5]
    if bad:
        raise IndexMismatch(f"files of the index were changed: {', '.join(bad)}")
    return VectorIndex(spark, version.path, manifest)
