"""Tables whose reads are verified while they are scanned.

A verified table has a manifest with its number of rows, the bytes of its rows and files, and a digest. Rows, bytes and digest
are observed metrics of the scan itself: they are collected by the tasks that read the rows anyway and compared when the action
ends, so a read stays one scan. The digest adds up parts of every row's SHA-256 in exact numbers, so it does not
depend on how rows are dealt out, and no task holds more than a sum.

What an action returns is handed on only after the comparison; a table that it writes becomes visible then. Nothing is
read before an action, and :meth:`VerifiedTable.cached` reads once for all later ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.sinks import guard_output
from corvane.sources.versions import Version, Versions, names, read_text, write_text
from corvane.storage import scratch_path

LANES, _DIGITS = 4, 15
MANIFEST, DATA = "manifest.json", "data"
MAX_MANIFEST_BYTES = 1 << 20
Result = TypeVar("Result")


class CorruptTable(ValueError):
    """The rows or files are not those of the manifest."""


class ResultNotReady(ValueError):
    """No result is recorded."""


def row_metrics(columns: Sequence[str]) -> list[Column]:
    """Aggregates over rows: their number, the bytes of their canonical form, and the digest's sums."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})
    lane = lambda i: F.conv(F.substring(F.sha2(row, 256), 1 + _DIGITS * i, _DIGITS), 16, 10).cast("decimal(20,0)")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.octet_length(row)), F.lit(0)).alias("row_bytes"),
        *[F.coalesce(F.sum(lane(i)), F.lit(0)).cast("string").alias(f"digest_{i}") for i in range(LANES)],
    ]


def _figures(seen: dict) -> dict:
    return {"rows": seen["rows"], "row_bytes": seen["row_bytes"], "digest": [seen[f"digest_{i}"] for i in range(LANES)]}


def observed(df: DataFrame, action: Callable[[DataFrame], Result]) -> tuple[Result, dict]:
    """What an action on ``df`` gives, and the figures of the rows that it read."""
    watch = Observation(uuid.uuid4().hex)
    result = action(df.observe(watch, *row_metrics(df.columns)))
    return result, _figures(watch.get)


def write_verified(df: DataFrame, root: str, inputs: Sequence[str] = (), **about) -> Version:
    """Write a new version of the table at ``root``. Its figures are observed by the write, so rows are made once."""
    guard_output(root, list(inputs))
    spark = df.sparkSession
    versions = Versions(spark, root)
    seen, path = versions.current(), versions.fresh()
    _, figures = observed(df, lambda rows: rows.write.parquet(f"{path}/{DATA}"))
    files = [size for name, size in names(spark, f"{path}/{DATA}") if not name.startswith(("_", "."))]
    manifest = figures | {"files": len(files), "file_bytes": sum(files), "schema": json.loads(df.schema.json()), "about": about}
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    return versions.publish(path, seen, rows=figures["rows"])


@dataclass
class VerifiedTable:
    """The current version of a verified table."""

    spark: SparkSession
    path: str
    manifest: dict
    _cached: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        """The unverified scan."""
        return self.spark.read.schema(T.StructType.fromJson(self.manifest["schema"])).parquet(f"{self.path}/{DATA}")

    def run(self, action: Callable[[DataFrame], Result]) -> Result:
        """The result of an action that reads all rows; CorruptTable if they are not the manifest's."""
        result, found = observed(self.rows, action)
        for name, value in found.items():
            if value != self.manifest[name]:
                raise CorruptTable(f"{self.path}: {name} is {value}, in the manifest {self.manifest[name]}")
        return result

    def write(self, root: str, make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Version:
        """Write what ``make`` makes of the rows as a version of ``root`` that is published after the comparison."""
        versions = Versions(self.spark, root)
        seen, path = versions.current(), versions.fresh()
        self.run(lambda rows: make(rows).write.parquet(path))
        return versions.publish(path, seen)

    def cached(self) -> DataFrame:
        """The rows, verified once and kept in shared storage."""
        if self._cached is None:
            path = scratch_path(self.spark, "verified")
            self.run(lambda rows: rows.write.parquet(path))
            self._cached = self.spark.read.schema(self.rows.schema).parquet(path)
        return self._cached


def read_verified(spark: SparkSession, root: str, max_bytes: int | None = None, max_rows: int | None = None) -> VerifiedTable:
    """The current version; its manifest and the sizes of its files are looked at, no row is read."""
    version = Versions(spark, root).current()
    if version is None:
        raise FileNotFoundError(f"{root} has no version")
    try:
        manifest = json.loads(read_text(spark, f"{version.path}/{MANIFEST}", MAX_MANIFEST_BYTES))
        T.StructType.fromJson(manifest["schema"])
        known = {k: manifest[k] for k in ("rows", "row_bytes", "digest", "files", "file_bytes")}
    except (KeyError, TypeError, json.JSONDecodeError) as error:
        raise CorruptTable(f"the manifest of {root} is not of this form") from error
    files = [size for name, size in names(spark, f"{version.path}/{DATA}") if not name.startswith(("_", "."))]
    if (len(files), sum(files)) != (known["files"], known["file_bytes"]):
        raise CorruptTable(f"{root} has {len(files)} files of {sum(files)} bytes, in the manifest {known['files']} of {known['file_bytes']}")
    for what, limit, value in (("bytes", max_bytes, sum(files)), ("rows", max_rows, known["rows"])):
        if limit is not None and value > limit:
            raise ValueError(f"{root} has {value} {what}; the limit is {limit}")
    return VerifiedTable(spark, version.path, manifest)


def fetch_results(
    records: DataFrame, root: str, schema: str, bound: Sequence[str] = ("brief.project_id", "final_report.project_id"), strict: bool = True
) -> DataFrame:
    """Records (project_id, result_object, result_size_bytes, result_sha256) with ``result``, the JSON file that
    ``result_object`` names below ``root``, parsed. Each file is read and checked in one scan: size, checksum, form, and that the
    fields of ``bound`` name the project. The first rule that fails makes the action fail, or with ``strict`` off fills ``failure``."""
    spark = records.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    parsed = F.from_json(F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")), schema, {"mode": "PERMISSIVE"})
    read = files.select(
        F.substring_index("path", plain, -1).alias("result_object"),
        F.col("length").alias("__size"),
        F.sha2("content", 256).alias("__sha256"),
        parsed.alias("result"),
    )
    joined = records.join(read, "result_object", "left")
    named = F.lit(True)
    for field in bound:
        named = named & F.col(f"result.{field}").eqNullSafe(F.col("project_id"))
    whole = F.lit(True)
    for field in bound:
        whole = whole & F.col(f"result.{field}").isNotNull()
    failure = (
        F.when(F.col("result_object").isNull() | F.col("result_sha256").isNull() | F.col("result_size_bytes").isNull(), "result_not_ready")
        .when(F.col("__size").isNull(), "result_missing")
        .when(F.col("__size") != F.col("result_size_bytes"), "size_mismatch")
        .when(F.col("__sha256") != F.lower("result_sha256"), "checksum_mismatch")
        .when(~whole, "schema_invalid")
        .when(~named, "project_binding_mismatch")
    )
    judged = joined.withColumn("failure", failure).withColumn("result", F.when(F.col("failure").isNull(), F.col("result")))
    if strict:
        told = F.raise_error(F.concat(F.col("failure"), F.lit(": "), F.coalesce("project_id", F.lit("?")))).cast("string")
        judged = judged.withColumn("failure", F.when(F.col("failure").isNotNull(), told)).filter("failure IS NULL")
    return judged.select(*records.columns, "result", "failure")
