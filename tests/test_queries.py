"""Every registered query of the engine against its DuckDB text, and plans that stay as meant."""

import glob
import os

import pytest

from trialweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    rows = lambda df: sorted((tuple(None if x != x or x is None else x for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_model_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["double_gaussian_2d", "grid_linspace", "sobol_8d", "sequential_sum_chain", "run_dir_names"])
def test_pointwise_queries_do_not_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in text and "Python" not in text


def test_cross_product_is_broadcast(spark):
    text = plan(QUERIES["campaign_flagship"](spark, SF))
    assert "BroadcastNestedLoopJoin" in text and "CartesianProduct" not in text
    assert "l_extendedprice" not in text


def test_process_queries_learn_from_every_part(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from trialweave.plans.queries import _fitted, _observed

    parts = spark.read.parquet(f"{SF}/part.parquet")
    _, best, rows = _fitted(spark, SF)
    assert _observed(rows).agg(F.sum("n")).first()[0] == parts.count()
    true = parts.select("p_partkey", (F.sin(3 * (F.col("p_size") - 1) / 49) + (F.col("p_retailprice") - 900) / 100).alias("y")).toPandas()
    found = QUERIES["gp_posterior"](spark, SF).toPandas().merge(true, on="p_partkey")
    assert best == pytest.approx(true["y"].max()) and len(found) == len(true)
    assert np.abs(found["mean"] - found["y"]).max() < 0.02
