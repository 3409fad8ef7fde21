"""Writers: guarded, deterministic, with manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import csv_safe
from corvane.sources.versions import Version, Versions


def guard_output(output: str, inputs: list[str]) -> None:
    """Output must not lie in, or be, a folder that is only read."""
    plain = lambda p: p.removeprefix("file://").removeprefix("file:").rstrip("/") + "/"
    for path in inputs:
        if plain(output).startswith(plain(path)):
            raise ValueError(f"{output} lies in {path}, which is only read")


def write_lines(df: DataFrame, path: str, order: list[str], inputs: list[str] | None = None, mode: str = "errorifexists") -> None:
    """JSON lines in a declared order, fields by name, nulls kept, so equal rows give equal bytes."""
    guard_output(path, inputs or [])
    fields = F.struct(*[F.col(c) for c in sorted(df.columns)])
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, inputs: list[str] | None = None) -> None:
    guard_output(path, inputs or [])
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, inputs: list[str] | None = None, encoding: str = "UTF-8", sep: str = ",") -> None:
    """CSV for people: no text begins with a formula sign."""
    guard_output(path, inputs or [])
    safe = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.option("header", True).option("encoding", encoding).option("sep", sep).csv(path)


def content_address(df: DataFrame, columns: list[str]) -> Column:
    """Aggregate: one hash over the sorted hashes of all rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
    return F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256)


def manifest(df: DataFrame, columns: list[str], **about: str) -> DataFrame:
    """One row: number of rows, content address, and what else is said of them. Row hashes are folded by their first
    digits, so no task holds those of all rows."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
    parts = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("p")).agg(
        F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: s["h"]), "")
    return parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.sha2(whole, 256).alias("content_address"),
        *[F.lit(v).alias(k) for k, v in sorted(about.items())],
    )


def verify(df: DataFrame, columns: list[str], stored: DataFrame) -> None:
    """Fail unless rows and content address are those of a stored manifest."""
    now, then = manifest(df, columns).first(), stored.first()
    if (now["rows"], now["content_address"]) != (then["rows"], then["content_address"]):
        raise ValueError("the rows are not those of the manifest")


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_atomically(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write beside ``path`` and take its place by two renames. The old table is put aside first, not deleted, and comes back
    if the second rename fails. Who opens ``path`` between the two finds no table; where that matters use
    :func:`publish_table`."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    plain = path.rstrip("/")
    staged, aside = (jvm.org.apache.hadoop.fs.Path(f"{plain}.{kind}-{uuid.uuid4().hex}") for kind in ("staged", "aside"))
    target = jvm.org.apache.hadoop.fs.Path(plain)
    df.write.parquet(staged.toString())
    files = staged.getFileSystem(conf)
    had = files.exists(target)
    if had and not files.rename(target, aside):
        raise OSError(f"cannot put {plain} aside")
    if not files.rename(staged, target):
        if had:
            files.rename(aside, target)
        raise OSError(f"cannot rename {staged}")
    if had:
        files.delete(aside, True)


def publish_table(spark: SparkSession, df: DataFrame, root: str) -> Version:
    """Make ``df`` the current version of ``root``: readers see the old table or the new one, and the old one's files stay
    for those that are reading them. Of two writers that began with the same version one fails."""
    versions = Versions(spark, root)
    seen, staged = versions.current(), versions.fresh()
    df.write.parquet(staged)
    return versions.publish(staged, seen)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """What :func:`publish_table` wrote last."""
    version = Versions(spark, root).current()
    if version is None:
        raise FileNotFoundError(f"{root} has no version")
    return spark.read.parquet(version.path)
