"""Fill-in-middle against a plain version in Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane.llm import fill_in_middle as fim

UNIT = re.compile(r"[^\n]*\n|[^\n]+")
ODD = [
    (900, "a\x1eb\nc\x1b\x1e\nd\x1bd\x1be", "en"),
    (901, "x <P> y\nz", "en"),
    (902, "ends here\n", "en"),
    (903, "\n\n\n", "en"),
    (904, "é😀\nü\r\n  tail", "en"),
    (905, "<\nP>\n<S\n>", "en"),
    (906, "\x1e", "en"),
    (907, "\x1b", "en"),
    (-5, "minus\none", "en"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = sha("7:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 50 else "psm"
    output = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(output), sha(text)


@pytest.fixture(scope="module")
def odd_dir(spark, docs_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fim"))
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs.union(spark.createDataFrame(ODD, docs.schema)).write.parquet(f"{path}/documents.parquet")
    return path


def test_query(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").collect()
    got = fim.query(spark, odd_dir)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    rows = [tuple(r) for r in got.collect()]
    assert Counter(rows) == Counter(brute(r.doc_id, r.text) for r in docs)
    assert {r[2] for r in rows} == {"plain", "psm", "spm"}


def test_oracle(spark, odd_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd_dir}/documents.parquet/*.parquet'")
    want = connection.execute(fim.ORACLE_SQL)
    names = [d[0] for d in want.description]
    assert Counter(want.fetchall()) == Counter(map(tuple, fim.query(spark, odd_dir).select(names).collect()))


def test_parts_and_columns(spark):
    """Columns of the results' and the working columns' names; other units; a lower rate."""
    rows = [(i, f"one two {i} three. four\x1e five. six.", "n", "row", "two", "digest") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, row string, two string, digest string")
    made = fim.cut_texts(docs, units=r"[^.]*\.|[^.]+", rate=30, spm_rate=10)
    assert made.columns == ["doc_id", "text", "row", "two", "digest", "n", "form", "prefix", "middle", "suffix", "output"]
    got = made.withColumn("again", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == 400
    for r in got:
        assert (r.row, r.two, r.digest, r.n, r.again) == ("row", "two", "digest", 3, r.text)
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == r.text
    forms = Counter(r.form for r in got)
    assert 80 < forms["psm"] + forms["spm"] < 160 and 0 < forms["spm"] < forms["psm"]


def test_plan_has_no_shuffle_and_no_python(spark, odd_dir):
    plan = fim.query(spark, odd_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
