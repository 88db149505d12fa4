"""Registered queries of models and designs that read whole tables: sparse processes, kernel regression, committees, core-sets, scrambled points, streams of completions, table functions, nested targets."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import space
from ..operators import coresets, kernel_stats, surrogate, table_functions
from ..operators import sparse_process as sparse
from ..sources import mappings
from ..streaming.completions import batch_accounts
from .campaign_queries import _folder
from .queries import _observed, _xy, query, table, unit_sql

# --- sparse processes ---------------------------------------------------------

_TWO = np.array([[0.2], [0.8]])


@query("""
WITH o AS (SELECT l_discount / 0.1::DOUBLE AS x, l_quantity / 50.0::DOUBLE AS y FROM lineitem WHERE l_discount IS NOT NULL AND l_quantity IS NOT NULL),
k AS (SELECT y, exp(-0.5::DOUBLE * (x - 0.2) * (x - 0.2) / 0.09) AS k1, exp(-0.5::DOUBLE * (x - 0.8) * (x - 0.8) / 0.09) AS k2 FROM o),
s AS (SELECT avg(y) AS m, stddev_samp(y) AS sd, sum(k1 * k1) / 0.04 AS a11, sum(k1 * k2) / 0.04 AS a12, sum(k2 * k2) / 0.04 AS a22, sum(k1 * y) AS t1, sum(k2 * y) AS t2, sum(k1) AS c1, sum(k2) AS c2 FROM k),
w AS (SELECT *, (t1 - m * c1) / sd / 0.04 AS b1, (t2 - m * c2) / sd / 0.04 AS b2, 1.0::DOUBLE + 1e-8::DOUBLE AS v, exp(-0.5::DOUBLE * 0.36 / 0.09) AS c FROM s),
i AS (SELECT *, (v + a11) * (v + a22) - (c + a12) * (c + a12) AS d, v * v - c * c AS e FROM w),
p AS (SELECT s_suppkey, exp(-0.5::DOUBLE * (x - 0.2) * (x - 0.2) / 0.09) AS q1, exp(-0.5::DOUBLE * (x - 0.8) * (x - 0.8) / 0.09) AS q2 FROM (SELECT s_suppkey, (s_suppkey % 100)::DOUBLE / 100 AS x FROM supplier))
SELECT s_suppkey, round(m + sd * ((q1 * (v + a22) - q2 * (c + a12)) * b1 + (q2 * (v + a11) - q1 * (c + a12)) * b2) / d, 6) AS mean,
  round(sd * sqrt(1.0::DOUBLE - (v * (q1 * q1 + q2 * q2) - 2 * c * q1 * q2) / e + (q1 * q1 * (v + a22) - 2 * q1 * q2 * (c + a12) + q2 * q2 * (v + a11)) / d), 6) AS sd
FROM p, i""")
def sparse_process_two(spark, d):
    """A process on two inducing points with fixed hyperparameters, over all line items: the closed form from sums."""
    seen = table(spark, d, "lineitem").select((F.col("l_discount") / 0.1).alias("x"), (F.col("l_quantity") / 50.0).alias("y"))
    (sums,) = sparse.gram_sums(seen, ["x"], "y", [(0, 1)], _TWO, "rbf", [np.array([0.3])])
    process = sparse.SparseProcess(_TWO, "rbf", np.array([0.3]), 0.04, sums)
    pool = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 100) / 100.0).alias("x"))
    return _posterior(pool, process, ["x"]).select("s_suppkey", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def _posterior(pool: DataFrame, process, parameters: list[str]) -> DataFrame:
    def task(batches):
        for pdf in batches:
            mean, sd = process.posterior(pdf[parameters].to_numpy(float))
            yield pdf.assign(mean=mean, sd=sd)

    return pool.mapInPandas(task, pool.select("*", F.lit(0.0).alias("mean"), F.lit(0.0).alias("sd")).schema)


@query()
def sparse_process(spark, d):
    """Length scales and noise by the variational bound on all line items, 36 inducing points; the posterior at each discount and tax."""


    rows = _xy(table(spark, d, "lineitem").where("l_quantity is not null")).select("x", "y")
    seen = rows.withColumn("z", F.sin(3 * F.col("x")) + F.col("y") * F.col("y"))
    process = sparse.fit(seen, ["x", "y"], "z", [(0, 1), (0, 1)], inducing=36, rounds=2, tries=4, seed=1)
    return _posterior(rows.select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y")).dropna().distinct(), process, ["x", "y"])


@query()
def expected_reduction(spark, d):
    """By how much observing a part would lower the mean variance over all parts, given all line items' discounts and taxes."""


    z = space.sobol_array(16, 2)
    seen = _xy(table(spark, d, "lineitem")).select("x", (F.col("y") / 2).alias("y"), F.col("x").alias("z"))
    (sums,) = sparse.gram_sums(seen, ["x", "y"], "z", [(0, 1), (0, 1)], z, "rbf", [np.array([0.4, 0.4])])
    parts = table(spark, d, "part").select("p_partkey", ((F.col("p_size") - 1) / 49).alias("x"), ((F.col("p_retailprice") - 900) / 100).alias("y"))
    out = sparse.variance_reduction(parts, sparse.SparseProcess(z, "rbf", np.array([0.4, 0.4]), 10.0, sums), ["x", "y"], [(0, 1), (0, 1)])
    return out.select("p_partkey", F.round("reduction", 9).alias("reduction"))


# --- kernel regression and committees --------------------------------------------

_BALANCE = "round((({c})::DOUBLE + 1000) / 11000, 2)"
_SEEN_SQL = f"SELECT o_orderkey AS id, c_nationkey / 24.0::DOUBLE AS u, {_BALANCE.format(c='c_acctbal')} AS v, o_totalprice / 100000.0::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey"
_ASKED_SQL = f"SELECT s_suppkey, s_nationkey / 24.0::DOUBLE AS u, {_BALANCE.format(c='s_acctbal')} AS v FROM supplier"


def _inputs(rows: DataFrame, nation: str, balance: str, *more) -> DataFrame:
    """Nation and balance as inputs in [0, 1], the balance to the hundredth: few different inputs, whatever the table."""
    return rows.select((F.col(nation) / 24.0).alias("u"), F.round((F.col(balance) + 1000) / 11000, 2).alias("v"), *more)


def _orders_and_suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bought = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    seen = _inputs(bought, "c_nationkey", "c_acctbal", F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000.0).alias("y"))
    return _inputs(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", F.col("s_suppkey")), seen


@query(f"""
WITH o AS (SELECT u, v, count(*)::DOUBLE AS n, sum(y) AS t, sum(y * y) AS s FROM ({_SEEN_SQL}) GROUP BY u, v),
k AS (SELECT s_suppkey, exp(-20.0::DOUBLE * ((a.u - o.u) * (a.u - o.u) + (a.v - o.v) * (a.v - o.v))) AS k, n, t, s FROM ({_ASKED_SQL}) a, o),
w AS (SELECT s_suppkey, sum(k * n) AS n, sum(k * t) AS t, sum(k * s) AS s FROM k GROUP BY s_suppkey),
m AS (SELECT *, (t + 0.5::DOUBLE * 2.0) / (n + 0.5) AS mean FROM w)
SELECT s_suppkey, round(mean, 6) AS mean, round(n, 4) AS weight,
  round(sqrt((4.0::DOUBLE * 1.5 + s + 0.5 * 4.0 - (n + 0.5) * mean * mean) / (n + 4) * (n + 1.5) / (n + 0.5) * (n + 4) / (n + 2)), 6) AS sd FROM m""")
def kernel_regression(spark, d):
    """Predictive mean and spread of order prices at every supplier's nation and balance, from all orders."""
    asked, seen = _orders_and_suppliers(spark, d)
    out = kernel_stats.kernel_regression(asked, seen, "s_suppkey", ["u", "v"], "y", 20.0, kernel_stats.NormalPrior(2.0, 0.5, 1.5, 4.0))
    return out.select("s_suppkey", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("weight", 4).alias("weight"))


def _poisson_sql(u: str) -> str:
    reached, chance, total = [], math.exp(-1.0), math.exp(-1.0)
    for k in range(1, 9):
        reached.append(f"({u} >= {total!r}::DOUBLE)::INTEGER")
        chance /= k
        total += chance
    return "(" + " + ".join(reached) + ")"


_MEMBERS = 3
_COMMITTEE_SQL = f"""
WITH o AS (SELECT *, {', '.join(f"{_poisson_sql(unit_sql(0, f'member/{b}', 'id'))} AS w{b}" for b in range(_MEMBERS))} FROM ({_SEEN_SQL})),
g AS (SELECT u, v, {', '.join(f"sum(w{b})::DOUBLE AS n{b}, sum(w{b} * y) AS t{b}" for b in range(_MEMBERS))} FROM o GROUP BY u, v),
k AS (SELECT s_suppkey, exp(-20.0::DOUBLE * ((a.u - g.u) * (a.u - g.u) + (a.v - g.v) * (a.v - g.v))) AS k, g.* FROM ({_ASKED_SQL}) a, g),
m AS (SELECT s_suppkey, {', '.join(f"(sum(k * t{b}) + 0.5::DOUBLE * 2.0) / (sum(k * n{b}) + 0.5) AS m{b}" for b in range(_MEMBERS))} FROM k GROUP BY s_suppkey),
a AS (SELECT *, ({' + '.join(f'm{b}' for b in range(_MEMBERS))}) / {_MEMBERS} AS mean FROM m)
SELECT s_suppkey, round(mean, 6) AS mean, round(sqrt(({' + '.join(f'(m{b} - mean) * (m{b} - mean)' for b in range(_MEMBERS))}) / {_MEMBERS}), 6) AS disagreement FROM a"""


@query(_COMMITTEE_SQL)
def committee_scores(spark, d):
    """How far three bootstrap members, drawn by hashes of the orders' keys, differ at every supplier."""
    asked, seen = _orders_and_suppliers(spark, d)
    out = kernel_stats.committee_scores(asked, seen, "s_suppkey", ["u", "v"], "y", 20.0, "id", _MEMBERS, kernel_stats.NormalPrior(2.0, 0.5, 1.5, 4.0))
    return out.select("s_suppkey", F.round("mean", 6).alias("mean"), F.round("disagreement", 6).alias("disagreement"))


@query()
def spread_choice(spark, d):
    """200 embeddings, each far from those chosen before, by core-sets of parts."""
    out = coresets.spread_choice(table(spark, d, "embeddings"), 200, "embedding", "vec_id", part_rows=1000)
    return out.select("rank", "vec_id", F.round("distance", 9).alias("distance"))


# --- hyperparameters and joint choices ---------------------------------------------


def _by_size(spark: SparkSession, d: str) -> tuple[np.ndarray, np.ndarray]:
    """The mean price of all parts of each size (50 sizes)."""
    rows = table(spark, d, "part").groupBy("p_size").agg(F.avg("p_retailprice").alias("y")).dropna().orderBy("p_size").toPandas()
    return (rows[["p_size"]].to_numpy(float) - 1) / 49, rows["y"].to_numpy(float)


@query()
def hyper_posterior(spark, d):
    """Length scale and noise of a process on the mean price of parts by size, drawn in four chains; their split R-hat."""
    x, y = _by_size(spark, d)
    return surrogate.split_r_hat(surrogate.hyper_chains(spark, surrogate.HyperPosterior(x, y), chains=4, draws=300, warmup=200, seed=1))


@query()
def joint_choice(spark, d):
    """Three places to observe together, given the means of all parts by cell."""
    seen = _observed(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), "p_retailprice")).orderBy("i", "j").toPandas()  # 400 rows at most
    gp = surrogate.GaussianProcess.fit(seen[["u", "v"]].to_numpy(float), seen["y"].to_numpy(float), seed=1, rounds=20)
    found = surrogate.joint_optimized(spark, gp, space.sobol_array(256, 2), 3, "qEI", restarts=4, raw=128, n_draws=64)
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(found)], "sample int, u double, v double")


# --- scrambled points -----------------------------------------------------------------

_KEYS = (0x9E3779B9, 0x85EBCA6B)


def _reverse_sql(x: str) -> str:
    for by, low in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        x = f"list_transform([{x}], lambda z: ((z & {low}) << {by}) | ((z >> {by}) & {low}))[1]"
    return x


def _owen_sql(x: str, key: int) -> str:
    x = f"({_reverse_sql(x)} + {key}) & 4294967295"
    for m in space.OWEN_MULTIPLIERS:
        x = f"list_transform([{x}], lambda z: xor(z, (z * {m & 0xFFFF} + (((z * {m >> 16}) & 65535) << 16)) & 4294967295))[1]"
    return _reverse_sql(x)


_GRAY = "xor(o_orderkey, o_orderkey >> 1)"
#: The second dimension's matrix is Pascal's triangle modulo 2: digit i of column j is whether j has all bits of i.
_PASCAL = f"list_reduce(list_transform(range(31), lambda j: CASE WHEN (({_GRAY}) >> j) & 1 = 1 THEN list_sum(list_transform(range(32), lambda i: CASE WHEN (i & j) = i AND i <= j THEN (1::BIGINT << (31 - i)) ELSE 0 END))::BIGINT ELSE 0::BIGINT END), lambda a, b: xor(a, b))"
_CORPUT = _reverse_sql(_GRAY)


@query(f"SELECT o_orderkey, round(({_owen_sql(_CORPUT, _KEYS[0])})::DOUBLE / 4294967296, 9) AS p0, round(({_owen_sql(_PASCAL, _KEYS[1])})::DOUBLE / 4294967296, 9) AS p1 FROM orders")
def scrambled_orders(spark, d):
    """Two coordinates of nested scrambled Sobol points, numbered by the orders' keys."""
    points = {f"p{k}": (k, key) for k, key in enumerate(_KEYS)}
    rows = space.with_owen_sobol(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), points, 31)
    return rows.select("o_orderkey", *[F.round(p, 9).alias(p) for p in points])


# --- streams ----------------------------------------------------------------------------


@query("SELECT event_id // 100 AS batch, 'complete' AS status, count(*) AS completed, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failures, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts IS NOT NULL GROUP BY 1 HAVING count(*) = 100")
def batch_completions(spark, d):
    """Events as completions of runs, 100 to a batch, that a stream brings in no order: batches are told of once all their runs are in."""
    folder = _folder(spark)
    rows = table(spark, d, "events").select((F.floor(F.col("event_id") / 100)).cast("long").alias("batch"), "ts", (F.col("event_type") == "error").alias("failed"), "event_id")
    rows.repartition(4, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("event_id", F.lit(1))).write.parquet(f"{folder}/runs")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/runs")
    out = run_to_end(batch_accounts(stream, 100, late="60 days"), folder)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


def run_to_end(accounts: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all input that there is, as a table; starting it again in the same ``folder`` goes on from its checkpoint."""
    spark, name = accounts.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        accounts.writeStream.format("parquet").option("path", f"{folder}/accounts").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(accounts.schema).parquet(f"{folder}/accounts")


# --- table functions and nested targets ---------------------------------------------------


@query("""
SELECT c_custkey, a.i AS sample, (a.i // 2)::DOUBLE AS c1, (a.i % 2)::DOUBLE AS c2 FROM customer, range(4) a(i)
""")
def points_by_table_function(spark, d):
    """Every customer beside a 2 x 2 grid, by a table function in SQL."""
    table_functions.register(spark)
    table(spark, d, "customer").select("c_custkey").createOrReplaceTempView("_trialweave_parents")
    config = json.dumps({"type": "GridSampler", "bounds": [[0, 1], [0, 1]], "num_samples": 2, "parameters": ["c1", "c2"]})
    return spark.sql(f"SELECT * FROM sample_points(TABLE(_trialweave_parents) PARTITION BY (c_custkey), '{config}')")


@query("""
SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 1 THEN o_custkey + 2.5 WHEN 2 THEN o_totalprice + 1.0 ELSE o_custkey + o_totalprice END, 6) AS output,
  round(CASE o_orderkey % 4 WHEN 0 THEN o_totalprice + 7 WHEN 1 THEN o_custkey + 2.5 WHEN 2 THEN o_totalprice + 4.0 ELSE o_custkey + o_totalprice END, 6) AS leaves FROM orders""")
def target_from_mappings(spark, d):
    """Results as nested JSON: the objective by precedence, and the sum of all numeric leaves at any depth."""
    key, price, customer = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_custkey")
    other = F.when(key % 4 == 0, F.to_json(F.struct(price.alias("distance"), F.lit(7).alias("output"))))
    other = other.when(key % 4 == 1, F.to_json(F.struct(F.array(customer.cast("double"), F.lit(2.5)).alias("output"), F.lit("text").alias("note"))))
    other = other.when(key % 4 == 2, F.to_json(F.struct(F.struct(price.alias("distance"), F.lit(1.0).alias("spread"), F.struct(F.lit(3.0).alias("deep")).alias("more")).alias("output"))))
    other = other.otherwise(F.to_json(F.struct(F.struct(price.alias("a"), customer.alias("b"), F.lit("x").alias("c")).alias("output"))))
    rows = table(spark, d, "orders").select("o_orderkey", F.parse_json(other).alias("payload"))
    named = mappings.with_nested_target(rows, "payload", ["distance", "spread"])
    return named.join(mappings.deep_sum(rows, "o_orderkey", "payload", "leaves"), "o_orderkey").select("o_orderkey", F.round("output", 6).alias("output"), F.round("leaves", 6).alias("leaves"))
