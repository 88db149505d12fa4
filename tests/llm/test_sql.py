"""Queries that SQL can express, against DuckDB on a standard table."""

import glob
import os

import pytest

from trialweave.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = con.sql(oracle_sql()[name])
    found = queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    rows = [tuple(r) for r in found.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


@pytest.mark.parametrize("name", ["op5_line_dedup", "op7_mixing", "op10_quality_rules"])
def test_native_queries_run_no_python(spark, name):
    text = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
