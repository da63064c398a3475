"""Corpus queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
