"""Registered queries over the standard tables, one per operator, each with its DuckDB equivalent where SQL can say it.

Standard tables stand in for parent datasets, candidate pools and run logs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import model, space, text
from ..functions import random as rnd
from ..operators import adaptive, expand, samplers, surrogate
from ..operators.runners import ExampleRunner, SumRunner, SyntheticDoubleGaussianRunner
from ..sources import scans, sinks
from ..streaming.micro_batch import windowed_progress
from .engine import run_sequence
from .progress import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def unit_sql(seed: int, name: str, index: str) -> str:
    """DuckDB's reading of ``functions.random.unit``."""
    return f"(('0x' || substr(md5('{seed}:{name}:' || CAST({index} AS VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496)"


def _xy(lineitem: DataFrame) -> DataFrame:
    """Line items as parent points: x and y in [0, 1]."""
    return lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_discount") / 0.1).alias("x"), (F.col("l_tax") / 0.08).alias("y"))


_XY = "SELECT l_orderkey, l_linenumber, l_returnflag, l_discount / 0.1::DOUBLE AS x, l_tax / 0.08::DOUBLE AS y FROM lineitem"
_2D = "0.2::DOUBLE*{x} + 0.1::DOUBLE*{y} + 1.0::DOUBLE*exp(-(({x}-0.3::DOUBLE)*({x}-0.3::DOUBLE) + ({y}-0.3::DOUBLE)*({y}-0.3::DOUBLE))/0.02::DOUBLE) + 0.8::DOUBLE*exp(-(({x}-0.75::DOUBLE)*({x}-0.75::DOUBLE) + ({y}-0.6::DOUBLE)*({y}-0.6::DOUBLE))/0.04::DOUBLE)"
_1D = "0.2::DOUBLE*{x} + 1.0::DOUBLE*exp(-({x}-0.2::DOUBLE)*({x}-0.2::DOUBLE)/0.001::DOUBLE) + 0.6::DOUBLE*exp(-({x}-0.7::DOUBLE)*({x}-0.7::DOUBLE)/0.01::DOUBLE)"


# --- samplers ---------------------------------------------------------------


@query("""
SELECT CAST(ia * 6 + ib * 2 + ic AS BIGINT) AS sample, a, b, c
FROM (VALUES (0, 5), (1, 7), (2, 77), (3, 199)) t(ia, a), (VALUES (0, 0.02::DOUBLE), (1, 0.2::DOUBLE), (2, 0.5::DOUBLE)) u(ib, b), (VALUES (0, 'x'), (1, 'y')) v(ic, c)
""")
def array_product(spark, d):
    return samplers.ArraySampler([[5, 7, 77, 199], [0.02, 0.2, 0.5], ["x", "y"]], ["a", "b", "c"]).batch(spark, 0)


_GRID = "SELECT i AS sample, CASE WHEN i // 300 = 299 THEN 1.0::DOUBLE ELSE (i // 300) * (1.0::DOUBLE / 299) + 0.0 END AS x, CASE WHEN i % 300 = 299 THEN 20.0::DOUBLE ELSE (i % 300) * (10.0::DOUBLE / 299) + 10.0 END AS y FROM range(90000) t(i)"


@query(_GRID)
def grid_linspace(spark, d):
    return samplers.GridSampler([(0, 1), (10, 20)], 300, ["x", "y"]).batch(spark, 0)


@query("SELECT i // 4 AS batch, i % 4 AS sample, CASE WHEN i = 9 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / 9) END AS x FROM range(10) t(i)")
def grid_batches(spark, d):
    s = samplers.GridSampler([(0, 1)], 10, ["x"], batch_size=4)
    return expand.union_batches([s.batch(spark, k).select(F.lit(k).cast("long").alias("batch"), "sample", "x") for k in range(s.n_batches)])


def _random(spark, distribution: str, bounds) -> DataFrame:
    out = samplers.RandomSampler([bounds], 5000, ["x"], distribution=distribution, seed=3).batch(spark, 0)
    return out if distribution == "int_uniform" else out.select("sample", F.round("x", 9).alias("x"))


@query(f"SELECT i AS sample, round(-5.0::DOUBLE + {unit_sql(3, 'x', 'i')} * 10.0::DOUBLE, 9) AS x FROM range(5000) t(i)")
def random_uniform(spark, d):
    return _random(spark, "uniform", (-5, 5))


@query(f"SELECT i AS sample, round(exp(ln(1.0::DOUBLE) + {unit_sql(3, 'x', 'i')} * (ln(10.0::DOUBLE) - ln(1.0::DOUBLE))), 9) AS x FROM range(5000) t(i)")
def random_loguniform(spark, d):
    return _random(spark, "loguniform", (1, 10))


@query(f"SELECT i AS sample, CAST(floor(1.0::DOUBLE + {unit_sql(3, 'x', 'i')} * 5.0::DOUBLE) AS BIGINT) AS x FROM range(5000) t(i)")
def random_int(spark, d):
    return _random(spark, "int_uniform", (1, 5))


@query(f"""SELECT i AS sample, round(3.0::DOUBLE + sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {unit_sql(3, 'x', 'i')})) * cos(6.283185307179586::DOUBLE * {unit_sql(3, "x''", 'i')}) * 1.0::DOUBLE, 9) AS x FROM range(5000) t(i)""")
def random_normal(spark, d):
    return _random(spark, "normal", (0, 6))


_LHS = samplers.LatinHypercubeSampler([(0, 1), (-2, 2)], 2500, ["c1", "c2"], batch_size=1000, seed=5)


def _permuted_sql(x: str, n: str, seed: int, name: str, batch: str) -> str:
    """DuckDB's reading of ``functions.random.permuted``."""
    k, c, a, b = (f"({list(v)}::BIGINT[])[r + 1]" for v in zip(*rnd.permutation_keys(seed, name), strict=True))
    partner = f"((({k} + ({batch}) * {c} % 2147483647) % ({n}) - x + ({n})) % ({n}))"
    bit = f"((((greatest(x, {partner}) % 2147483647) * {a} + {b}) % 2147483647) >> 12) & 1"
    return f"list_reduce(list_concat([({x})::BIGINT], range(48)), lambda x, r: CASE WHEN {bit} = 1 THEN {partner} ELSE x END)"


def _lhs_sql() -> str:
    dims, n = [], "least(1000, 2500 - (i // 1000) * 1000)"
    for p, low, span in (("c1", "0.0", "1.0"), ("c2", "-2.0", "4.0")):
        dims.append(f"round({low}::DOUBLE + (({_permuted_sql('i % 1000', n, 5, p, 'i // 1000')} + {unit_sql(5, p, 'i')}) / {n}) * {span}::DOUBLE, 9) AS {p}")
    return f"SELECT i // 1000 AS batch, i % 1000 AS sample, {', '.join(dims)} FROM range(2500) t(i)"


@query(_lhs_sql())
def lhs_design(spark, d):
    frames = [_LHS.batch(spark, k).select(F.lit(k).cast("long").alias("batch"), "sample", *[F.round(c, 9).alias(c) for c in ("c1", "c2")]) for k in range(_LHS.n_batches)]
    return expand.union_batches(frames)


@query("SELECT b AS batch, s AS stratum, CAST(1 AS BIGINT) AS n1, CAST(1 AS BIGINT) AS n2 FROM range(3) t(b), range(1000) u(s) WHERE b < 2 OR s < 500")
def lhs_strata_check(spark, d):
    """Every stratum of every batch and dimension has one point."""
    rows = _LHS.frame(spark, 0, 2500).withColumn("batch", F.floor(F.col("sample") / 1000).cast("long"))
    n = F.when(F.col("batch") == 2, 500).otherwise(1000)
    both = rows.select("batch", F.explode(F.array(F.struct(F.lit(1).alias("dim"), F.floor(F.col("c1") * n).cast("long").alias("s")), F.struct(F.lit(2).alias("dim"), F.floor((F.col("c2") + 2) / 4 * n).cast("long").alias("s")))).alias("p"))
    return both.groupBy("batch", F.col("p.s").alias("stratum")).agg(F.count(F.when(F.col("p.dim") == 1, 1)).alias("n1"), F.count(F.when(F.col("p.dim") == 2, 1)).alias("n2"))


@query("SELECT b AS batch, least(3, 10 - b * 3) AS n FROM range(4) t(b)")
def lhs_last_batch(spark, d):
    s = samplers.LatinHypercubeSampler([(0, 1)], 10, ["c1"], batch_size=3)
    return expand.union_batches([s.batch(spark, k).groupBy(F.lit(k).cast("long").alias("batch")).agg(F.count("*").alias("n")) for k in range(s.n_batches)])


def _sobol_sql(dims: int, log2: int) -> str:
    out = []
    for k in range(dims):
        bits = "0::BIGINT"
        for j, v in enumerate(space.sobol_directions(k)[:log2]):
            bits = f"xor({bits}, ((g >> {j}) & 1) * {v})"
        out.append(f"({bits})::DOUBLE / 4294967296 AS p{k}")
    return f"SELECT i AS sample, {', '.join(out)} FROM (SELECT i, xor(i, i >> 1) AS g FROM range({1 << log2}) t(i))"


@query(_sobol_sql(2, 12))
def sobol_2d(spark, d):
    return samplers.SobolSequenceSampler([(0, 1)] * 2, 4096, ["p0", "p1"], scramble=False).batch(spark, 0)


@query(_sobol_sql(8, 10))
def sobol_8d(spark, d):
    return samplers.SobolSequenceSampler([(0, 1)] * 8, 1024, [f"p{k}" for k in range(8)], scramble=False).batch(spark, 0)


@query("""
SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, b AS bits, CAST(1 AS BIGINT) AS points
FROM range(13) u(b), LATERAL (SELECT unnest(range(1 << b)) AS x), LATERAL (SELECT unnest(range(1 << (12 - b))) AS y)""")
def sobol_net(spark, d):
    """4,096 points in two dimensions: each box of every dyadic partition into 4,096 boxes holds one, as is known of this sequence."""
    points = samplers.SobolSequenceSampler([(0, 1)] * 2, 4096, ["p0", "p1"], scramble=False).batch(spark, 0)
    boxes = points.select(F.explode(F.sequence(F.lit(0), F.lit(12))).alias("b"), "p0", "p1")
    place = lambda p, b: F.floor(F.col(p) * F.pow(F.lit(2.0), b)).cast("long")
    boxes = boxes.select(place("p0", F.col("b")).alias("x"), place("p1", 12 - F.col("b")).alias("y"), F.col("b").cast("long").alias("bits"))
    return boxes.groupBy("x", "y", "bits").agg(F.count("*").alias("points"))


@query("SELECT i * 3 + j AS sample, CASE WHEN i = 3 THEN 2.0::DOUBLE ELSE i * (2.0::DOUBLE / 3) END AS c1, CAST(j + 10 AS INTEGER) AS c2 FROM range(4) t(i), range(3) u(j)")
def nested_sampler(spark, d):
    """Both samplers have c2: the later one's counts."""
    first = samplers.GridSampler([(0, 2), (0, 1)], [4, 1], ["c1", "c2"])
    return samplers.NestedSampler({"a": first, "b": samplers.ArraySampler([[10, 11, 12]], ["c2"])}).batch(spark, 0)


@query("SELECT s_nationkey, round(sum(log10(n)) OVER (ORDER BY s_nationkey), 6) AS log10_runs FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1)")
def level_run_counts(spark, d):
    """The suppliers of each nation as the size of a level: the runs at each depth, as logarithms, since the product of all is too large to hold."""
    found = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    sizes = [tuple(r) for r in found.orderBy("s_nationkey").collect()]  # a row per nation
    s = samplers.NestedSampler({str(k): samplers.ArraySampler([range(n)], [f"p{k}"]) for k, n in sizes})
    rows = [(k, round(math.log10(n), 6)) for (k, _), n in zip(sizes, s.runs_by_depth, strict=True)]
    return spark.createDataFrame(rows, found.select("s_nationkey").schema.add("log10_runs", "double"))


@query("SELECT c_name AS run_dir, c_custkey::DOUBLE AS input, c_acctbal AS output FROM customer")
def parser_scan(spark, d):
    return scans.parsed(table(spark, d, "customer").select(F.col("c_name").alias("run_dir"), F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("output")))


# --- expansion and runners --------------------------------------------------


@query("""
SELECT p.parent * 2 + s.sample AS sample, p.n_nationkey, p.n_name, s.c1 AS c1, s.c2 AS c2
FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS parent, n_nationkey, n_name FROM nation) p, (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (1, 1.0::DOUBLE, 1.0::DOUBLE)) s(sample, c1, c2)
""")
def nested_cross_parent(spark, d):
    """Parents x samples; c1 exists on both sides and the sample's value wins."""
    parents = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("parent"), "n_nationkey", "n_name", F.lit(-1.0).alias("c1"))
    points = samplers.GridSampler([(0, 1), (1, 2)], [2, 1], ["c1", "c2"]).batch(spark, 0)
    return expand.cross_parents(parents, points, 2)


@query("""
SELECT (r.r_regionkey * 4 + a.i) * 4 + b.j AS sample, r.r_regionkey, (a.i // 2)::DOUBLE AS c1, (a.i % 2)::DOUBLE AS c2, (b.j // 2)::DOUBLE AS c3, (b.j % 2)::DOUBLE AS c4
FROM region r, range(4) a(i), range(4) b(j)
""")
def three_level_nested(spark, d):
    regions = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("parent"), "r_regionkey")
    grid = lambda *names: samplers.GridSampler([(0, 1)] * 2, 2, names).batch(spark, 0)
    second = expand.cross_parents(regions, grid("c1", "c2"), 4)
    return expand.cross_parents(second.withColumnRenamed("sample", "parent"), grid("c3", "c4"), 4)


@query("SELECT p_partkey, round(p_size + p_retailprice, 6) AS output FROM part")
def sum_runner(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("sample"), "p_size", "p_retailprice")
    out = SumRunner(["p_size", "p_retailprice", "absent"], name="r1").apply(rows, ["p_size", "p_retailprice"])
    return out.select(F.col("sample").alias("p_partkey"), F.round("output", 6).alias("output"))


@query("SELECT p_partkey, NOT abs(p_size::DOUBLE - 7.0) < 0.25 AS success, CASE WHEN abs(p_size::DOUBLE - 7.0) < 0.25 THEN NULL ELSE p_size::DOUBLE END AS output FROM part")
def sum_runner_fail_if(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size")
    return SumRunner(["p_size"], fail_if=7, name="r1").apply(rows, ["p_size"]).select("p_partkey", "success", "output")


@query("SELECT i AS sample, 5.0::DOUBLE AS c1, 1.0::DOUBLE AS c2, 12.0::DOUBLE AS output, true AS success_r1, true AS success_r2, 'd0_b0_s' || i || '_r1' AS run_dir FROM range(10) t(i)")
def sequential_sum_chain(spark, d):
    points = spark.range(10).select(F.col("id").alias("sample"), F.lit(5.0).alias("c1"), F.lit(1.0).alias("c2"))
    out = run_sequence(points, [SumRunner(["c1", "c2"], name="r1"), SumRunner(["output", "c1", "c2"], name="r2")])
    return out.select("sample", "c1", "c2", "output", "success_r1", "success_r2", "run_dir")


@query("SELECT * FROM (VALUES ('r1', CAST(12 AS BIGINT), CAST(3 AS BIGINT)), ('r2', CAST(12 AS BIGINT), CAST(4 AS BIGINT))) t(runner, runs, failures)")
def failure_accounting_nested(spark, d):
    """Failed rows go on; each runner's flags are counted."""
    first = run_sequence(samplers.ArraySampler([[1.0, 2.0, 1.0, 3.0]], ["c1"]).batch(spark, 0), [SumRunner(["c1"], fail_if=2, name="r1")])
    points = samplers.ArraySampler([[1.0, 3.0, 1.0]], ["c2"]).batch(spark, 0)
    rows = expand.cross_parents(first.withColumn("parent", F.col("sample")), points, 3)
    out = run_sequence(rows, [SumRunner(["c1", "c2"], fail_if=4, name="r2")], depth=1)
    flags = out.select(F.explode(F.array(*[F.struct(F.lit(r).alias("runner"), F.col(f"success_{r}").alias("ok")) for r in ("r1", "r2")])).alias("f"))
    return flags.groupBy(F.col("f.runner").alias("runner")).agg(F.count("*").alias("runs"), F.count(F.when(~F.col("f.ok"), 1)).alias("failures"))


@query(f"WITH p AS ({_XY}) SELECT l_orderkey, l_linenumber, round({_1D.format(x='x')}, 9) AS output FROM p")
def double_gaussian_1d(spark, d):
    out = SyntheticDoubleGaussianRunner(1).apply(_xy(table(spark, d, "lineitem")), ["x"])
    return out.select("l_orderkey", "l_linenumber", F.round("output", 9).alias("output"))


@query(f"WITH p AS ({_XY}) SELECT l_orderkey, l_linenumber, round({_2D.format(x='x', y='y')}, 9) AS output FROM p")
def double_gaussian_2d(spark, d):
    out = SyntheticDoubleGaussianRunner(2).apply(_xy(table(spark, d, "lineitem")), ["x", "y"])
    return out.select("l_orderkey", "l_linenumber", F.round("output", 9).alias("output"))


@query("SELECT l_orderkey, l_linenumber, l_tax + l_discount AS output, true AS success FROM lineitem")
def example_runner_sum(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0.0).alias("c1"), F.col("l_tax").alias("c10"), F.col("l_discount").alias("c9"))
    return ExampleRunner().apply(rows, ["c1", "c9", "c10"]).select("l_orderkey", "l_linenumber", "output", "success")


@query(f"SELECT o_orderkey, NOT {unit_sql(1, 'example_runner/fail', 'o_orderkey')} < 0.3 AS success FROM orders")
def soft_failure_rate(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.lit(1.0).alias("c1"), F.lit(2.0).alias("c2"))
    return ExampleRunner(fail_prob=0.3).apply(rows, ["c1", "c2"], seed=1).select(F.col("sample").alias("o_orderkey"), "success")


# --- projections, unions, accounts ------------------------------------------


def _runs(spark, d) -> DataFrame:
    """Orders as runs: open ones failed."""
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("success"), F.col("o_totalprice").alias("output"), F.col("o_custkey").alias("c1"))


@query("SELECT o_custkey AS c1, o_totalprice AS output FROM orders WHERE o_orderstatus <> 'P'")
def success_filter(spark, d):
    return adaptive.observations(_runs(spark, d), ["c1"])


@query("SELECT round(o_totalprice, 6) AS output, [o_custkey::DOUBLE, o_orderkey::DOUBLE][1] AS first, [o_custkey::DOUBLE, o_orderkey::DOUBLE][2] AS second FROM orders WHERE o_orderstatus <> 'P'")
def observation_matrix(spark, d):
    rows = adaptive.observations(_runs(spark, d), ["c1", "o_orderkey"])
    x = rows.select(F.round("output", 6).alias("output"), F.array(F.col("c1").cast("double"), F.col("o_orderkey").cast("double")).alias("x"))
    return x.select("output", F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_projection(spark, d):
    return sinks.numeric(table(spark, d, "part"))


@query("SELECT p_name AS run, 'p_size' AS \"column\", p_size::DOUBLE AS value FROM part UNION ALL SELECT p_name, 'p_retailprice', p_retailprice FROM part UNION ALL SELECT p_name, 'p_partkey', p_partkey::DOUBLE FROM part")
def hdf5_long_layout(spark, d):
    return sinks.long_layout(table(spark, d, "part"), "p_name")


_PROGRESS = """
SELECT CAST(event_id % 7 AS BIGINT) AS batch, count(*) AS total, count(*) AS completed, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS successes,
  CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failures, round(100.0::DOUBLE * count(*) FILTER (WHERE event_type <> 'error') / count(*), 6) AS success_rate
FROM events WHERE event_type IS NOT NULL GROUP BY 1"""


@query(_PROGRESS)
def progress_by_batch(spark, d):
    runs = table(spark, d, "events").where("event_type is not null").select((F.col("event_id") % 7).alias("batch"), (F.col("event_type") != "error").alias("success"))
    return progress(runs, ("batch",)).select("batch", "total", "completed", "successes", "failures", F.round("success_rate", 6).alias("success_rate"))


@query("SELECT s_suppkey, '[' || repeat('#', CAST(floor(least(1.0::DOUBLE, s_suppkey::DOUBLE / 80) * 40) AS INTEGER)) || repeat('-', 40 - CAST(floor(least(1.0::DOUBLE, s_suppkey::DOUBLE / 80) * 40) AS INTEGER)) || '] ' || printf('%5.1f%%', least(1.0::DOUBLE, s_suppkey::DOUBLE / 80) * 100) AS bar FROM supplier")
def progress_bar_text(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.progress_bar(F.col("s_suppkey"), F.lit(80)).alias("bar"))


@query("SELECT 'd' || (l_linenumber % 3) || '_b' || (l_orderkey % 10) || '_s' || l_orderkey || '_r' || l_linenumber AS run_dir, true AS ok FROM lineitem")
def run_dir_names(spark, d):
    name = text.run_dir(F.col("l_linenumber") % 3, F.col("l_orderkey") % 10, F.col("l_orderkey"), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select(name.alias("run_dir")).withColumn("ok", text.is_run_dir(F.col("run_dir")))


@query("SELECT c_custkey AS id, c_acctbal AS output, c_mktsegment AS segment, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def batch_union_missing_cols(spark, d):
    one = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("output"), F.col("c_mktsegment").alias("segment"))
    two = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("output"), F.col("s_name").alias("name"))
    return expand.union_batches([one, two])


@query("SELECT c_name AS run_dir, c_custkey::DOUBLE AS x, c_acctbal - 2.0::DOUBLE AS objective, 0 AS failure FROM customer")
def objective_projection(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_name").alias("run_dir"), F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("output"))
    return scans.objective(rows).select("run_dir", F.get("inputs", F.lit(0)).alias("x"), "objective", "failure")


@query("SELECT c_nationkey, max(c_acctbal) AS best, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS at FROM customer GROUP BY 1")
def best_observation(spark, d):
    best = space.best_of(F.col("c_acctbal"), F.col("c_custkey")).alias("b")
    return table(spark, d, "customer").groupBy("c_nationkey").agg(best).select("c_nationkey", "b.best", "b.at")


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)")
def standardize_objective(spark, d):
    rows = space.standardized(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("z")), "z")
    return rows.select("c_custkey", F.round("z", 6).alias("z"))


@query("SELECT p_partkey, round((p_size - 1.0::DOUBLE) / 49.0::DOUBLE, 9) AS u1, round((p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE, 9) AS u2 FROM part")
def normalize_inputs(spark, d):
    u = lambda c, low, high: F.round(space.normalize(F.col(c), low, high), 9)
    return table(spark, d, "part").select("p_partkey", u("p_size", 1, 50).alias("u1"), u("p_retailprice", 900, 1000).alias("u2"))


@query("SELECT o_custkey AS c1, o_totalprice AS output, CASE WHEN o_orderstatus <> 'P' THEN 'observed' ELSE 'failed' END AS store FROM orders")
def failure_routing(spark, d):
    runs = _runs(spark, d)
    good = adaptive.observations(runs, ["c1"]).withColumn("store", F.lit("observed"))
    bad = adaptive.failures(runs, ["c1", "output"]).withColumn("store", F.lit("failed"))
    return good.unionByName(bad)


@query("SELECT s_suppkey, s_acctbal + s_nationkey::DOUBLE AS objective FROM supplier")
def target_reduction(spark, d):
    rows = table(spark, d, "supplier")
    return rows.select("s_suppkey", adaptive.reduced_target(rows.columns, ["s_acctbal", "s_nationkey", "absent"]).alias("objective"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def leaf_sums(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(model.leaf_sum(F.col("embedding")), 6).alias("total"))


_GREEDY = """
WITH seen AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id < 10),
pool AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id >= 10)
SELECT vec_id, round(min(list_distance(pool.e, seen.e)), 6) AS distance FROM pool, seen GROUP BY vec_id ORDER BY distance DESC, vec_id LIMIT 20"""


@query(_GREEDY)
def greedy_pool_step(spark, d):
    """The 20 candidates farthest from what is known: the known vectors are one small row beside each candidate."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    known = rows.where("vec_id < 10").agg(F.collect_list("e").alias("known"))
    scored = rows.where("vec_id >= 10").crossJoin(F.broadcast(known)).select("vec_id", F.round(adaptive.least_distance(F.col("e"), F.col("known")), 6).alias("distance"))
    return scored.orderBy(F.desc("distance"), "vec_id").limit(20)


def _pool(budget: int) -> adaptive.ActiveLearningSampler:
    return adaptive.ActiveLearningSampler([(0, 1), (-1, 1)], budget, ["x", "y"], "GSx", 400, batch_size=6, seed=4)


_POOL_SQL = f"SELECT i AS cand_id, {unit_sql(4, 'pool/x', 'i')} AS x, -1.0::DOUBLE + {unit_sql(4, 'pool/y', 'i')} * 2.0::DOUBLE AS y FROM range(400) t(i)"


@query(f"SELECT cand_id, round(x, 9) AS x, round(y, 9) AS y FROM ({_POOL_SQL}) WHERE cand_id % 7 <> 0")
def pool_remove_selected(spark, d):
    """Candidates that have been run leave the pool, whatever came of them."""
    s = _pool(6)
    run = s.pool(spark).where("cand_id % 7 = 0").withColumn("success", F.col("cand_id") % 2 == 0)
    return s.remaining(spark, run).select("cand_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query(f"""
WITH RECURSIVE pool AS MATERIALIZED ({_POOL_SQL}), gaps AS MATERIALIZED (
  SELECT c.cand_id AS a, k.cand_id AS b, (c.x - k.x) * (c.x - k.x) + (c.y - k.y) * (c.y - k.y) AS d FROM pool c, pool k WHERE c.cand_id % 40 <> 0
), picks AS (
  SELECT 0 AS step, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT step + 1, list_append(taken, (
    SELECT a FROM gaps WHERE (b % 40 = 0 OR list_contains(taken, b)) AND NOT list_contains(taken, a) GROUP BY a ORDER BY min(d) DESC, a LIMIT 1)) FROM picks WHERE step < 6
)
SELECT row_number() OVER (ORDER BY cand_id) - 1 AS sample, round(x, 9) AS x, round(y, 9) AS y FROM pool, (SELECT unnest(taken) AS t FROM picks WHERE step = 6) WHERE cand_id = t
""")
def active_learning_picks(spark, d):
    """Six picks by distance in the inputs, each counting those before as known."""
    s = _pool(12)
    seen = s.pool(spark).where("cand_id % 40 = 0").select("x", "y", (F.col("x") + F.col("y")).alias("output"), F.lit(True).alias("success"))
    return s.propose(spark, seen, 1).select("sample", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@query("SELECT c_name AS run_dir, c_acctbal AS output FROM customer WHERE c_nationkey >= 5 AND NOT contains(c_name, '77')")
def history_unseen(spark, d):
    rows = table(spark, d, "customer")
    history = rows.select(F.col("c_name").alias("run_dir"), F.col("c_acctbal").alias("output"))
    return scans.unseen(history, rows.where("c_nationkey < 5").select(F.col("c_name").alias("run_dir")), skip=["77"])


@query("SELECT event_id, (event_id // 3600) * 3600 + ((event_id // 60) % 60) * 60 + event_id % 60 AS seconds FROM events")
def clock_seconds(spark, d):
    i = F.col("event_id")
    clock = F.concat_ws(":", F.floor(i / 3600).cast("long").cast("string"), (F.floor(i / 60) % 60).cast("string"), (i % 60).cast("string"))
    return table(spark, d, "events").select("event_id", text.clock_seconds(clock).alias("seconds"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS completed, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failures FROM events WHERE ts IS NOT NULL GROUP BY 1")
def windowed_runs(spark, d):
    return windowed_progress(table(spark, d, "events"))


_FLAGSHIP = f"""
WITH p AS ({_XY}), g(ox, oy) AS (SELECT (i // 2) * 0.1::DOUBLE, (i % 2) * 0.1::DOUBLE FROM range(4) t(i)),
q AS (SELECT l_returnflag, x + ox AS x, y + oy AS y FROM p, g), r AS (SELECT l_returnflag, {_2D.format(x='x', y='y')} AS output FROM q)
SELECT l_returnflag, count(*) AS total, CAST(count(*) FILTER (WHERE NOT abs(output - 1.0) < 0.25) AS BIGINT) AS successes, CAST(count(*) FILTER (WHERE abs(output - 1.0) < 0.25) AS BIGINT) AS failures FROM r GROUP BY 1"""


@query(_FLAGSHIP)
def campaign_flagship(spark, d):
    """Line items as parents x a 2 x 2 grid of offsets -> double Gaussian -> sum runner that fails near 1 -> account by flag."""
    parents = _xy(table(spark, d, "lineitem")).withColumn("parent", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    points = samplers.GridSampler([(0, 0.1)] * 2, 2, ["ox", "oy"]).batch(spark, 0)
    rows = expand.cross_parents(parents, points, 4)
    rows = rows.withColumn("x", F.col("x") + F.col("ox")).withColumn("y", F.col("y") + F.col("oy"))
    out = run_sequence(rows, [SyntheticDoubleGaussianRunner(2, name="gauss"), SumRunner(["output"], fail_if=1.0, name="sum")])
    return progress(out, ("l_returnflag",)).select("l_returnflag", "total", "successes", "failures")


# --- models -----------------------------------------------------------------


@query("""
WITH p AS (SELECT s_suppkey, (s_suppkey % 100)::DOUBLE / 100 AS x FROM supplier),
k AS (SELECT *, exp(-0.5::DOUBLE * (x - 0.2) * (x - 0.2) / 0.09) AS k1, exp(-0.5::DOUBLE * (x - 0.8) * (x - 0.8) / 0.09) AS k2, exp(-0.5::DOUBLE * 0.36 / 0.09) AS c, 1.01::DOUBLE + 1e-8::DOUBLE AS v FROM p),
q AS (SELECT *, 2.0::DOUBLE + (k2 - k1) / (v - c) AS mean, sqrt(2.0::DOUBLE) * sqrt(1.0::DOUBLE - (v * (k1 * k1 + k2 * k2) - 2 * c * k1 * k2) / (v * v - c * c)) AS sd FROM k)
SELECT s_suppkey, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean + sqrt(0.2::DOUBLE) * sd, 6) AS acquisition FROM q""")
def process_of_two_points(spark, d):
    """A Gaussian process with fixed hyperparameters on (0.2, 1) and (0.8, 3), in closed form, and its upper confidence bound."""
    gp = surrogate.GaussianProcess.with_hyper(np.array([[0.2], [0.8]]), np.array([1.0, 3.0]), "rbf", np.array([0.3]), 0.01)
    pool = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 100) / 100.0).alias("x"))
    out = adaptive.score_pool(pool, gp, ["x"], [(0, 1)], "qUCB")
    return out.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "acquisition")])


# --- models (no SQL) --------------------------------------------------------


def _observed(parts: DataFrame) -> DataFrame:
    """Means of inputs and output, rows and greatest output of each cell of a 20 x 20 grid, over all parts."""
    u, v = (F.col("s") - 1) / 49, (F.col("p_retailprice") - 900) / 100
    cell = [F.least(F.greatest(F.floor(c * 20), F.lit(0)), F.lit(19)).alias(name) for c, name in ((u, "i"), (v, "j"))]
    rows = parts.select(*cell, u.alias("u"), v.alias("v"), (F.sin(3 * u) + v).alias("y")).where("y IS NOT NULL")
    return rows.groupBy("i", "j").agg(*[F.avg(c).alias(c) for c in ("u", "v", "y")], F.count("*").alias("n"), F.max("y").alias("best"))


def _fitted(spark, d) -> tuple[surrogate.GaussianProcess, float, DataFrame]:
    """The process on the cells' means, the best output of any part, and the parts."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), "p_retailprice")
    seen = _observed(parts).orderBy("i", "j").toPandas()  # 400 rows at most
    gp = surrogate.GaussianProcess.fit(seen[["u", "v"]].to_numpy(float), seen["y"].to_numpy(float), seed=1)
    return gp, float(seen["best"].max()), parts


def _scored(spark, d, name: str) -> DataFrame:
    gp, best, parts = _fitted(spark, d)
    return adaptive.score_pool(parts, gp, ["s", "p_retailprice"], [(1, 50), (900, 1000)], name, best=best)


@query()
def gp_posterior(spark, d):
    return _scored(spark, d, "EI").select("p_partkey", "mean", "sd")


@query()
def expected_improvement(spark, d):
    return _scored(spark, d, "EI").select("p_partkey", "acquisition").orderBy(F.desc("acquisition"), "p_partkey").limit(20)


@query()
def bo_round(spark, d):
    """One round of Bayesian optimization after 30 observations."""
    s = adaptive.BayesianOptimizationSampler([(0, 1), (0, 1)], ["x", "y"], budget=5, initial_samples=30, acquisition_batch_size=5, seed=2)
    seen = SyntheticDoubleGaussianRunner(2).apply(s.frame(spark, 0, 30), ["x", "y"])
    return s.propose(spark, seen, 1)


@query()
def active_learning_round(spark, d):
    s = adaptive.ActiveLearningSampler([(0, 1), (0, 1)], 40, ["x", "y"], "GreedySamplingTarget", 500, batch_size=4, seed=2)
    seen = SyntheticDoubleGaussianRunner(2).apply(s.batch(spark, 0), ["x", "y"])
    return s.propose(spark, seen, 1)


from . import campaign_queries, model_queries  # noqa: E402, F401  register those that run the engine, and models over tables
