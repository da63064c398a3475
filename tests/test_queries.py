"""Raster queries against their SQL in DuckDB, and the entry points without the corpus parts."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from gridloom import queries as Q

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    db = duckdb.connect()
    for file in os.listdir(SF):
        db.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return db


def rounded(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, tables, name):
    got, want = Q.queries()[name](spark, SF), tables.sql(Q.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted((tuple(map(rounded, r)) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(map(rounded, r)) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)


@pytest.mark.parametrize("name", ["windowed_scan", "windowed_scan_box"])
def test_a_raster_file_may_have_more_pixels_than_an_export(spark, tmp_path, name):
    rows = [(11 * 128, 7 * 16, 3.0), (30 * 128 + 5, 40 * 16, 4.0), (30 * 128 + 5, 40 * 16 + 15, 2.5), (9_000_000, 1_200_000, 7.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = db.sql(Q.oracle_sql()[name])
    assert sorted(map(tuple, Q.queries()[name](spark, str(tmp_path)).select(*want.columns).collect())) == sorted(want.fetchall())


def test_wide_queries_hold_the_pixels_of_the_table_only(spark, tables):
    cells = tables.sql(f"{Q._WIDE} SELECT count(*) FROM cells").fetchall()[0][0]
    bound = Q.wide_layers(spark, SF)
    assert Q.evaluate_tiles(bound, "a * 2 + q / 4 - 1").agg(Q.F.sum(Q.F.size("data"))).first()[0] == cells
    assert Q.evaluate_pixels(bound, "a * (q > 30)", 256).count() == cells


def test_formula_scan_prunes_and_aggregates_partially(spark):
    plan = Q.flagship(spark, SF)._jdf.queryExecution().toString()
    assert "partial_count" in plan and "ReadSchema: struct<l_orderkey" in plan and "Python" not in plan


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
@pytest.mark.parametrize("path", ["", ROOT])
def test_entry_works_without_the_corpus_parts(tmp_path, gone, path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone, ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'value_count_discrete' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": path})
