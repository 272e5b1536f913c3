"""Operators that have SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

from quirework.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    frame = queries.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    cursor = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(k)] for k in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns and sorted((tuple(r[k] for k in columns) for r in frame.collect()), key=repr) == want
