"""Corpus builds and the vector index."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane import build as B
from corvane import vector_index as V
from corvane.operators import corpus as C
from corvane.sources import versions

SETTINGS = B.Settings(C.Thresholds(min_characters=10, min_hangul_ratio=0.0, min_filled_pages=0.5), 60)
SOURCE = "doc string, source_checksum string, pages array<struct<page:int,section:string,text:string>>, orphan boolean"


def sources(spark, docs):
    rows = [(d, str(hash(tuple(p))), [(i + 1, None, t) for i, t in enumerate(p)], o) for d, (p, o) in docs.items()]
    return lambda: spark.createDataFrame(rows, SOURCE)


def parse(rows):
    return rows.withColumn("risky_name", F.lit(False))


DOCS = {f"d{i}": ([f"page {j} of {i} " * 3 for j in range(4)], False) for i in range(12)} | {
    "short": (["x"], False),
    "none": ([], True),
    "twin": ([f"page {j} of 3 " * 3 for j in range(4)], False),
}


def shown(build):
    return {r.doc: (r.status, r.duplicate_of, r.n_chunks, r.part) for r in build.documents.collect()}


def test_changes_alone_are_built(spark, tmp_path):
    root = f"{tmp_path}/corpus"
    first = B.build_corpus(sources(spark, DOCS), parse, spark, root, SETTINGS)
    found = shown(first)
    assert found["short"][:3] == ("low_text", None, 0) and found["none"][:3] == ("orphan_pdf", None, 0)
    assert found["twin"][:2] == ("duplicate", "d3") and found["d3"][0] == "ready" and found["d3"][2] > 1
    # d3 changes: its twin owns its body now, and its chunks are there already. d4 goes, another comes.
    docs = dict(DOCS) | {"d3": (["quite other text " * 3], False), "new": (["a new document " * 2], False)}
    del docs["d4"]
    second = B.build_corpus(sources(spark, docs), parse, spark, root, SETTINGS)
    part = second.version.about["part"]
    now = shown(second)
    assert {d for d, r in now.items() if r[3] == part} == {"d3", "new"}
    assert now["twin"][:2] == ("ready", None) and "d4" not in now
    stored = spark.read.parquet(f"{root}/parts/{part}")
    assert {r.doc for r in stored.select("doc").distinct().collect()} == {"d3", "new"}
    # As a build from nothing.
    full = B.build_corpus(sources(spark, docs), parse, spark, f"{tmp_path}/full", SETTINGS)
    assert [r.asDict() for r in second.manifest.collect()] == [r.asDict() for r in full.manifest.collect()]
    chunks = lambda b: sorted((r.doc, r.chunk_index, r.text) for r in b.chunks.collect())
    assert chunks(second) == chunks(full) and {c[0] for c in chunks(second)} == {d for d, r in now.items() if r[0] == "ready"}
    row = B.summary(second).first()
    assert (row.documents, row.low_text, row.orphan_pdf, row.duplicate) == (15, 1, 1, 0) and row.chunks == len(chunks(second))
    # The earlier build is still whole.
    assert shown(first) == found and first.chunks.count() == sum(r[2] for r in found.values() if r[0] == "ready")
    # Nothing changed: nothing is made. Other settings: all is.
    again = B.build_corpus(sources(spark, docs), parse, spark, root, SETTINGS)
    assert {r[3] for r in shown(again).values()}.isdisjoint({again.version.about["part"]})
    other = B.build_corpus(sources(spark, docs), parse, spark, root, B.Settings(SETTINGS.thresholds, 1000))
    assert {r[3] for r in shown(other).values()} == {other.version.about["part"]}
    assert B.open_build(spark, root).version == other.version


def test_changed_sources_abort(spark, tmp_path):
    root, reads = f"{tmp_path}/corpus", []

    def moving():
        reads.append(1)
        return sources(spark, {"a": ([f"text of read {len(reads)} " * 3], False)})()

    with pytest.raises(B.SourceChanged):
        B.build_corpus(moving, parse, spark, root, SETTINGS)
    assert versions.Versions(spark, root).current() is None and os.listdir(f"{root}/parts") == []


def test_empty_build(spark, tmp_path):
    made = B.build_corpus(lambda: spark.createDataFrame([], SOURCE), parse, spark, f"{tmp_path}/c", SETTINGS)
    assert made.documents.count() == 0 and made.chunks.count() == 0 and made.manifest.first().rows == 0


def test_two_builds_at_once(spark, tmp_path):
    """A build that began before another was published fails."""
    root = f"{tmp_path}/c"

    def late(rows):
        if B.Versions(spark, root).current() is None:
            B.build_corpus(sources(spark, DOCS), parse, spark, root, SETTINGS)
        return parse(rows)

    with pytest.raises(versions.Conflict):
        B.build_corpus(sources(spark, DOCS), late, spark, root, SETTINGS)


def test_files(spark, tmp_path):
    tree = tmp_path / "data" / "brief"
    tree.mkdir(parents=True)

    def put(name, pages):
        body = {"metadata": {"filename": f"{name}.pdf"}, "full_text": "\n".join(p["text"] for p in pages), "page_texts": pages}
        (tree / f"{name}.json").write_text(json.dumps(body), encoding="utf-8")

    put("2020_Kim_One", [{"page": 1, "text": "first page " * 5}, {"page": 2, "text": " "}])
    put("2021_Lee_Two", [{"page": 1, "text": "another page " * 5}])
    (tree / "2022_Park_Three.pdf").write_bytes(b"%PDF-1.4 no json")
    root = f"{tmp_path}/data"
    make = lambda: B.build_corpus(lambda: B.file_sources(spark, root), B.file_parser(spark, root), spark, f"{tmp_path}/out", SETTINGS)
    first = make()
    assert sorted(r[0] for r in shown(first).values()) == ["orphan_pdf", "ready", "ready"]
    put("2021_Lee_Two", [{"page": 1, "text": "changed page " * 5}])
    second = make()
    assert [r[3] for r in shown(second).values()].count(second.version.about["part"]) == 1
    put("2021_Lee_Two", [{"page": 0, "text": "no such page"}])
    with pytest.raises(PySparkException, match="unexpected parser failure"):
        make()


PROVIDER = V.hash_axis_provider(8, 100)
CHUNK = "chunk_id string, publication_id string, chunk_index int, checksum string, chunking_version string, text string"


def chunk_rows(spark, texts):
    rows = [(f"c{i}", f"p{i % 3}", i, None, "1", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK).withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256))


TEXTS = [f"text {i}" for i in range(40)] + ["", "x" * 101, None]


def test_index(spark, tmp_path):
    root = f"{tmp_path}/index"
    V.build_index(chunk_rows(spark, TEXTS), root, PROVIDER, "1")
    index = V.open_index(spark, root, PROVIDER, "1")
    m = index.manifest
    assert (m["input_chunks"], m["indexed_chunks"], m["skipped_chunks"]) == (43, 40, 3)
    assert {r.chunk_id: r.failure_code for r in index.skipped.collect()} == {"c40": "empty_input", "c41": "input_too_long", "c42": "empty_input"}
    stored = sorted((r.position, r.publication_id, r.chunk_index) for r in index.entries.collect())
    assert [s[0] for s in stored] == list(range(1, 41)) and [s[1:] for s in stored] == sorted(s[1:] for s in stored)
    best = index.search("text 7", PROVIDER, 5).collect()
    assert best[0].score == 1.0 and "c7" in {r.chunk_id for r in index.search("text 7", PROVIDER, 40).filter("score = 1").collect()}
    allowed = spark.createDataFrame([("p1",)], "publication_id string")
    assert {r.publication_id for r in index.search("text 7", PROVIDER, 40, allowed).collect()} == {"p1"}
    assert index.search(" ", PROVIDER, 5).count() == 0 and index.search("text", PROVIDER, 0).count() == 0
    # The same chunks in another order give the same manifest.
    V.build_index(chunk_rows(spark, TEXTS).orderBy(F.desc("chunk_index")).repartition(3), f"{tmp_path}/again", PROVIDER, "1")
    assert V.open_index(spark, f"{tmp_path}/again", PROVIDER, "1").manifest == m


@pytest.mark.parametrize(
    ("fault", "column", "value"),
    [
        ("repeated_chunk_id", "chunk_id", "'c1'"),
        ("repeated_position", "chunk_index", "0"),
        ("version_mismatch", "chunking_version", "if(chunk_id = 'c3', '2', '1')"),
        ("checksum_mismatch", "checksum", "if(chunk_id = 'c3', '0', checksum)"),
        ("missing_identity", "publication_id", "if(chunk_id = 'c3', NULL, publication_id)"),
    ],
)
def test_chunks_that_break_a_rule(spark, tmp_path, fault, column, value):
    with pytest.raises(V.IndexBuildError, match=fault):
        V.build_index(chunk_rows(spark, TEXTS).withColumn(column, F.expr(value)), f"{tmp_path}/i", PROVIDER, "1")
    assert versions.Versions(spark, f"{tmp_path}/i").current() is None


@pytest.mark.parametrize(
    ("fault", "values", "code"),
    [
        ("no_outcome", "NULL", "NULL"),
        ("two_outcomes", "array(1.0, 0.0)", "'empty_input'"),
        ("failed: rate_limited", "NULL", "'rate_limited'"),
        ("wrong_dimension", "array(1.0)", "NULL"),
        ("not_finite", "array(1.0, double('NaN'))", "NULL"),
        ("zero_norm", "array(0.0, 0.0)", "NULL"),
    ],
)
def test_vectors_that_break_a_rule(spark, tmp_path, fault, values, code):
    made = lambda text: F.struct(F.expr(values).cast("array<double>").alias("values"), F.expr(code).cast("string").alias("failure_code"))
    with pytest.raises(V.IndexBuildError, match=fault):
        V.build_index(chunk_rows(spark, TEXTS), f"{tmp_path}/i", V.Provider("m", "1", 2, made), "1")


@pytest.mark.parametrize("name", V.SETTINGS)
def test_other_settings_are_refused(spark, tmp_path, name):
    from dataclasses import replace

    V.build_index(chunk_rows(spark, TEXTS[:4]), f"{tmp_path}/i", PROVIDER, "1")
    other = {
        "embedding_model_id": replace(PROVIDER, embedding_model_id="x"),
        "embedding_version": replace(PROVIDER, embedding_version="2"),
        "dimension": replace(PROVIDER, dimension=9),
        "normalization": replace(PROVIDER, normalized=False),
    }.get(name, PROVIDER)
    with pytest.raises(V.IndexMismatch, match=name):
        V.open_index(spark, f"{tmp_path}/i", other, "2" if name == "chunking_version" else "1")
    if other is not PROVIDER:
        with pytest.raises(V.IndexMismatch, match=name):
            V.open_index(spark, f"{tmp_path}/i", PROVIDER, "1").search("text", other, 3)


def test_changed_index_files(spark, tmp_path):
    root = f"{tmp_path}/i"
    version = V.build_index(chunk_rows(spark, TEXTS), root, PROVIDER, "1")
    name = next(n for n in os.listdir(f"{version.path}/entries") if n.endswith(".parquet"))
    path = f"{version.path}/entries/{name}"
    with open(path, "r+b") as f:
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    os.remove(f"{version.path}/entries/.{name}.crc")
    V.open_index(spark, root, PROVIDER, "1", verify_files=False)  # sizes alone do not tell
    with pytest.raises(V.IndexMismatch, match="files"):
        V.open_index(spark, root, PROVIDER, "1")
    os.remove(path)
    with pytest.raises(V.IndexMismatch, match="files"):
        V.open_index(spark, root, PROVIDER, "1", verify_files=False)
    manifest = json.loads(versions.read_text(spark, f"{version.path}/manifest.json")) | {"indexed_chunks": 1}
    versions.write_text(spark, f"{version.path}/manifest.json", json.dumps(manifest))
    with pytest.raises(V.IndexMismatch, match="manifest"):
        V.open_index(spark, root, PROVIDER, "1")


def test_commands(spark, tmp_path, capsys):
    from corvane import cli

    tree = tmp_path / "data" / "brief"
    tree.mkdir(parents=True)
    for i in range(3):
        pages = [{"page": 1, "text": f"가나다 page of {i} 라마바사아 " * 3}]
        body = {"metadata": {"filename": f"202{i}_Kim_Doc.pdf"}, "full_text": pages[0]["text"], "page_texts": pages}
        (tree / f"202{i}_Kim_Doc.json").write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
    out, index = f"{tmp_path}/out", f"{tmp_path}/index"
    cli.main(["build", "--input", f"{tmp_path}/data", "--output", out, "--min-characters", "20"])
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (said["documents"], said["ready"], said["chunks"]) == (3, 3, 3)
    cli.main(["index", "--corpus", out, "--output", index])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["indexed_chunks"] == 3
    cli.main(["nearest", "--index", index, "--query", "page", "--limit", "2"])
    assert capsys.readouterr().out.count("pub:kida_brief") >= 2
    with pytest.raises(ValueError, match="only read"):
        cli.main(["build", "--input", f"{tmp_path}/data", "--output", f"{tmp_path}/data/out"])
