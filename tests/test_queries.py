"""Every query of the reference's operators against its DuckDB oracle."""

from __future__ import annotations

import os

import duckdb
import pytest

from corvane.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{DIR}/{t}.parquet"
        path += "/*.parquet" if os.path.isdir(path) else ""
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return connection


def shown(value):
    return None if value is None else repr(float(value)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql()])
def test_oracle(spark, oracle, name):
    found = catalogue.queries()[name](spark, DIR)
    columns = sorted(found.columns)
    got = sorted(tuple(map(str, (shown(r[c]) for c in columns))) for r in found.collect())
    cursor = oracle.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    rows = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert got == sorted(tuple(map(str, (shown(r[c]) for c in columns))) for r in rows)


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n not in catalogue.oracle_sql()])
def test_without_oracle(spark, name):
    """Two runs give the same rows."""
    run = lambda: sorted(map(str, catalogue.queries()[name](spark, DIR).collect()))
    assert run() == run()
