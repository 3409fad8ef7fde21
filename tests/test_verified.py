"""Versions, verified reads and checked result files."""

from __future__ import annotations

import hashlib
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.sources import sinks, verified, versions


@pytest.fixture
def table(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = spark.range(5000).select("id", F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, F.col("id") / 7).alias("x"))
    verified.write_verified(rows.repartition(4), root, made_by="test")
    return root


def data_files(root):
    return sorted(f"{d}/{f}" for d, _, names in os.walk(root) for f in names if f.endswith(".parquet"))


def test_read_is_one_verified_scan(spark, table):
    read = verified.read_verified(spark, table)
    assert read.manifest["rows"] == 5000 and read.manifest["about"] == {"made_by": "test"}
    assert read.run(lambda df: df.agg(F.sum("id")).first()[0]) == sum(range(5000))
    plans = []
    read.run(lambda df: plans.append(df.groupBy((F.col("id") % 5).alias("k")).count()) or plans[0].collect())
    assert plans[0]._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert read.cached().count() == 5000 and read.cached() is read.cached()


def test_order_and_parts_do_not_matter(spark, table, tmp_path):
    again = str(tmp_path / "again")
    verified.write_verified(verified.read_verified(spark, table).rows.orderBy(F.desc("text")), again)
    first, second = (verified.read_verified(spark, p).manifest for p in (table, again))
    assert all(first[k] == second[k] for k in ("rows", "row_bytes", "digest"))


def test_changed_rows_fail_the_action(spark, table, tmp_path):
    """The same number of rows and of row bytes, one value changed: only the digest can tell."""
    read = verified.read_verified(spark, table)
    changed = read.rows.withColumn("text", F.when(F.col("id") == 77, "text 78").otherwise(F.col("text")))
    other = str(tmp_path / "other")
    verified.write_verified(changed, other)
    forged = verified.read_verified(spark, other)
    forged.manifest = read.manifest
    with pytest.raises(verified.CorruptTable, match="digest"):
        forged.run(lambda df: df.collect())
    out = str(tmp_path / "out")
    with pytest.raises(verified.CorruptTable):
        forged.write(out)
    assert versions.Versions(spark, out).current() is None  # nothing was published
    read.write(out, lambda df: df.filter("id < 10").unionByName(df.filter("id >= 10").limit(0)))


def test_changed_byte(spark, table):
    path = data_files(table)[0]
    with open(path, "r+b") as f:
        body = f.read()
        f.seek(body.index(b"text ") + 2)
        f.write(b"X")
    os.remove(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc")
    read = verified.read_verified(spark, table)
    with pytest.raises((verified.CorruptTable, PySparkException)):
        read.run(lambda df: df.collect())


def test_partial_read_is_no_verification(spark, table):
    with pytest.raises(verified.CorruptTable):
        verified.read_verified(spark, table).run(lambda df: df.limit(3).collect())


def test_files_and_limits(spark, table):
    with pytest.raises(ValueError, match="limit"):
        verified.read_verified(spark, table, max_bytes=100)
    with pytest.raises(ValueError, match="limit"):
        verified.read_verified(spark, table, max_rows=4999)
    os.remove(data_files(table)[0])
    with pytest.raises(verified.CorruptTable, match="files"):
        verified.read_verified(spark, table)


def test_manifest_of_another_form(spark, table):
    current = versions.Versions(spark, table).current()
    versions.write_text(spark, f"{current.path}/manifest.json", '{"rows": 1}')
    with pytest.raises(verified.CorruptTable):
        verified.read_verified(spark, table)
    versions.write_text(spark, f"{current.path}/manifest.json", " " * ((1 << 20) + 1))
    with pytest.raises(ValueError, match="limit"):
        verified.read_verified(spark, table)


def test_one_of_two_writers_wins(spark, tmp_path):
    box = versions.Versions(spark, str(tmp_path / "box"))
    seen = box.current()
    first = box.publish(box.fresh(), seen, by="first")
    with pytest.raises(versions.Conflict):
        box.publish(box.fresh(), seen, by="second")
    assert box.current() == first and first.about == {"by": "first"}
    assert box.publish(box.fresh(), first, by="second").number == 2
    with pytest.raises(ValueError):
        box.publish(str(tmp_path / "elsewhere"), box.current())


def test_publish_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish_table(spark, spark.range(3), path)
    old = sinks.read_current(spark, path)
    sinks.publish_table(spark, spark.range(5), path)
    assert (old.count(), sinks.read_current(spark, path).count()) == (3, 5)
    with pytest.raises(FileNotFoundError):
        sinks.read_current(spark, str(tmp_path / "none"))


def test_results(spark, tmp_path):
    def put(name, project, cut=0):
        body = json.dumps({"brief": {"project_id": project}, "final_report": {"project_id": project, "text": "é"}}).encode()
        (tmp_path / name).write_bytes(body[: len(body) - cut])
        return name, len(body), hashlib.sha256(body).hexdigest()

    good, short, other = put("a.json", "a"), put("b.json", "b", 1), put("c.json", "x")
    (tmp_path / "d.json").write_bytes(b"[1]")
    (tmp_path / "e.json").write_bytes(b"\xff\xfe")
    rows = [
        ("a", *good),
        ("b", *short),
        ("c", *other),
        ("d", "d.json", 3, hashlib.sha256(b"[1]").hexdigest()),
        ("e", "e.json", 2, hashlib.sha256(b"\xff\xfe").hexdigest()),
        ("f", "f.json", 2, "0" * 64),
        ("g", None, None, None),
        ("h", good[0], good[1], "0" * 64),
    ]
    records = spark.createDataFrame(rows, "project_id string, result_object string, result_size_bytes long, result_sha256 string")
    schema = "brief struct<project_id: string>, final_report struct<project_id: string, text: string>"
    got = {r.project_id: r for r in verified.fetch_results(records, str(tmp_path), schema, strict=False).collect()}
    assert {k: r.failure for k, r in got.items()} == {
        "a": None,
        "b": "size_mismatch",
        "c": "project_binding_mismatch",
        "d": "schema_invalid",
        "e": "schema_invalid",
        "f": "result_missing",
        "g": "result_not_ready",
        "h": "checksum_mismatch",
    }
    assert got["a"].result.final_report.text == "é" and got["c"].result is None
    assert verified.fetch_results(records.filter("project_id = 'a'"), str(tmp_path), schema).count() == 1
    with pytest.raises(PySparkException, match="size_mismatch"):
        verified.fetch_results(records.filter("project_id IN ('a', 'b')"), str(tmp_path), schema).collect()
