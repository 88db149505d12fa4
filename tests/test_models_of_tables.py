"""Sparse processes, kernel regression, committees, core-sets, joint choices, hyperparameter chains, scrambled points, streams of completions, nested targets, table functions and extended designs, against plain versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.functions import space
from trialweave.operators import adaptive, coresets, kernel_stats, samplers, sums, surrogate, table_functions
from trialweave.operators import sparse_process as sparse
from trialweave.plans.engine import Engine
from trialweave.plans.config import parse
from trialweave.plans.model_queries import run_to_end
from trialweave.sources import mappings
from trialweave.streaming.completions import batch_accounts

# --- extending ------------------------------------------------------------------------


def campaign(folder, sampler, mode="fresh"):
    runners = {"r": {"type": "SumRunner", "params_to_sum": ["c1"]}}
    return parse({"samplers": {"s": sampler}, "runners": runners, "supervisor": {"base_run_dir": str(folder), "run_mode": mode, "run_order": [{"sampler": "s", "runner": "r"}]}})


@pytest.mark.parametrize("kind, budget, size, more, want", [("LatinHypercubeSampler", 10, 4, 4, 14), ("SobolSequenceSampler", 8, 8, 8, 16), ("RandomSampler", 8, 4, 4, 12), ("ArraySampler", None, 2, 4, 4)])
def test_extended_campaigns_have_new_points(spark, tmp_path, kind, budget, size, more, want):
    config = {"type": kind, "bounds": [[0, 1]], "parameters": ["c1"], "budget": budget, "batch_size": size, "seed": 3}
    if kind == "ArraySampler":
        config = {"type": kind, "bounds": [[1, 2, 3, 4]], "parameters": ["c1"], "batch_size": 2}
    first = Engine(spark, campaign(tmp_path, config)).run().select("batch", "sample", "c1").collect()
    found = Engine(spark, campaign(tmp_path, config, "extend")).run({"s": more}).select("batch", "sample", "c1").collect()
    assert len(found) == want and len({r.c1 for r in found}) == want and set(map(tuple, first)) <= set(map(tuple, found))
    if kind == "SobolSequenceSampler":
        fresh = samplers.SobolSequenceSampler([[0, 1]], 16, ["c1"], seed=3).batch(spark, 0).collect()
        assert {r.c1 for r in found} == {r.c1 for r in fresh}
    if kind == "LatinHypercubeSampler":
        sizes = {b: sorted(math.floor(r.c1 * n) for r in found if r.batch == b) for b, n in ((0, 4), (1, 4), (2, 2), (3, 4))}
        assert sizes == {b: list(range(n)) for b, n in ((0, 4), (1, 4), (2, 2), (3, 4))}  # each batch is a hypercube of its own


# --- scrambled points --------------------------------------------------------------------


def owen_points(spark, log2, dims, seed, kind="owen"):
    s = samplers.SobolSequenceSampler([(0, 1)] * dims, 1 << log2, [f"p{k}" for k in range(dims)], scramble=kind, seed=seed)
    return s.batch(spark, 0).orderBy("sample").select(*s.parameters).toPandas().to_numpy()


def test_owen_scrambling_keeps_every_net(spark):
    for seed in (1, 2):
        x = owen_points(spark, 6, 2, seed)
        for a in range(7):  # every box of area 2 ** -6 has one point
            boxes = {(math.floor(u * 2**a), math.floor(v * 2 ** (6 - a))) for u, v in x}
            assert len(boxes) == 64
    many = owen_points(spark, 5, 40, 3)  # beyond the table of directions
    assert many.shape == (32, 40) and all(sorted(np.floor(many[:, k] * 32)) == list(range(32)) for k in range(40))
    assert len({tuple(many[:, k]) for k in range(40)}) == 40
    with pytest.raises(ValueError):
        samplers.SobolSequenceSampler([(0, 1)], 8, ["x"], scramble="other")


def plain_owen(bits, key):
    """Digit by digit: what is flipped depends on the key and the digits before."""
    reverse = lambda v: int(f"{v:032b}"[::-1], 2)
    x = (reverse(bits) + key) % 2**32
    for m in space.OWEN_MULTIPLIERS:
        x ^= x * m % 2**32
    return reverse(x)


def test_owen_scrambling_is_a_nested_permutation(spark):
    values = [0, 1, 2**31, 2**32 - 1, *np.random.default_rng(0).integers(0, 2**32, 200).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    found = {r.v: r.s for r in df.select("v", space.owen_scrambled(F.col("v"), 0x9E3779B9).alias("s")).collect()}
    assert found == {v: plain_owen(v, 0x9E3779B9) for v in values}
    for v in values[4:40]:
        for n in (1, 5, 17, 31):  # numbers that share n digits still share n digits, and no more
            other = plain_owen(v ^ (1 << (31 - n)), 0x9E3779B9)
            assert (found[v] ^ other).bit_length() == 32 - n


def test_owen_scrambling_has_less_variance_than_a_shift(spark):
    import random

    seeds, columns = range(12), {}
    for kind in ("owen", "shift"):
        for seed in seeds:
            keys = [random.Random(f"{seed}:{k}").getrandbits(32) for k in range(3)]
            point = [space.sobol(F.col("id"), k, 5, **{kind: key}) for k, key in enumerate(keys)]
            columns[kind, seed] = F.avg(F.exp(point[0] + point[1] + point[2]))
    row = spark.range(32).agg(*columns.values()).first()
    found = dict(zip(columns, row, strict=True))
    owen, shift = (np.array([found[kind, seed] for seed in seeds]) for kind in ("owen", "shift"))
    true = (math.e - 1) ** 3
    assert abs(owen.mean() - true) < 0.05 and ((owen - true) ** 2).mean() < 0.5 * ((shift - true) ** 2).mean()


def shifts(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("shift")


def test_scrambling_writes_no_step_out_twice(spark):
    from trialweave.plans.queries import QUERIES

    orders = QUERIES["scrambled_orders"](spark, "/root/testdata/sf0.001")  # 31 digits: two shifts each, and ten of one reversal
    assert shifts(orders) < 2 * 100 and "lambda" not in orders._jdf.queryExecution().optimizedPlan().toString()
    for dims in (1, 4):
        columns = [space.sobol(F.col("id"), k, 31, owen=5 + k).alias(f"p{k}") for k in range(dims)]
        assert shifts(spark.range(4).select(*columns)) < dims * 150
        sampler = samplers.SobolSequenceSampler([(0, 1)] * dims, 1 << 20, [f"p{k}" for k in range(dims)])
        assert shifts(sampler.frame(spark, 0, 1 << 20)) < dims * 100


def test_scrambled_points_of_a_table_equal_plain_ones(spark):
    index = [None, 0, 1, 2, 3, 2**16, 2**31 - 1, *np.random.default_rng(1).integers(0, 2**31, 200).tolist()]
    points = {f"p{k}": (k, 0x9E3779B9 + k) for k in (0, 1, 2, 20)}  # the last is beyond the table of directions
    rows = spark.createDataFrame([(i,) for i in index], "i long")
    found = space.with_owen_sobol(rows, F.col("i"), points, 31)
    assert found.columns == ["i", *points]
    columns = rows.select("i", *[space.sobol(F.col("i"), k, 31, owen=key).alias(p) for p, (k, key) in points.items()])
    assert columns.collect() == found.collect()
    narrow = space.with_owen_sobol(rows.select(F.col("i").cast("int")), F.col("i"), points, 31)
    assert narrow.collect() == found.collect()
    for r in found.collect():
        for p, (k, key) in points.items():
            bits = 0
            for j, v in enumerate(space.sobol_directions(k)):
                bits ^= v if r.i is not None and (r.i ^ r.i >> 1) >> j & 1 else 0
            assert r[p] == (None if r.i is None else plain_owen(bits, key) / 2**32)


def test_primitive_polynomials_go_on_where_the_table_ends():
    known = [(1 << d) | (c << 1) | 1 for d, c, _ in space.SOBOL_TABLE]
    assert space.primitive_polynomials(len(known)) == known


# --- sparse processes -----------------------------------------------------------------------


def dense(x, y, z, scales, noise, at, name):
    """The posterior with covariance K_nm K_mm^-1 K_mn + noise, by n x n matrices."""
    mean, scale = y.mean(), y.std(ddof=1)
    kmm = surrogate.kernel(name, z, z, scales) + sparse.JITTER * np.eye(len(z))
    knm, ksm = surrogate.kernel(name, x, z, scales), surrogate.kernel(name, at, z, scales)
    q = knm @ np.linalg.solve(kmm, knm.T) + noise * np.eye(len(x))
    cross = ksm @ np.linalg.solve(kmm, knm.T)
    variance = 1 - np.einsum("ij,ji->i", cross, np.linalg.solve(q, cross.T))
    log_det = np.linalg.slogdet(q)[1]
    zed = (y - mean) / scale
    trace = len(x) - np.trace(knm @ np.linalg.solve(kmm, knm.T))
    bound = -0.5 * (zed @ np.linalg.solve(q, zed) + log_det + len(x) * math.log(2 * math.pi)) - 0.5 * trace / noise
    return mean + scale * cross @ np.linalg.solve(q, zed), scale * np.sqrt(variance), bound, q


def test_sparse_process_equals_the_dense_form(spark):
    rng = np.random.default_rng(2)
    x, z = rng.random((300, 2)), rng.random((15, 2))
    y = np.sin(4 * x[:, 0]) + x[:, 1] + 0.1 * rng.standard_normal(300)
    rows = [(float(10 * a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 0.5, 1.0), (1.0, float("nan"), 1.0), (1.0, 0.5, float("inf"))]
    df = spark.createDataFrame(rows, "a double, b double, out double").repartition(7)
    scales = [np.array([0.5, 0.8]), np.array([0.2, 0.3])]
    for s, found in zip(scales, sparse.gram_sums(df, ["a", "b"], "out", [(0, 10), (0, 1)], z, "matern52", scales, fan_in=2), strict=True):
        process = sparse.SparseProcess(z, "matern52", s, 0.05, found)
        at = rng.random((20, 2))
        mean, sd, bound, _ = dense(x, y, z, s, 0.05, at, "matern52")
        assert process.posterior(at)[0] == pytest.approx(mean, abs=1e-6) and process.best == y.max()
        prior = surrogate.kernel("matern52", at, z, s)
        lost = 1 - np.einsum("ij,ji->i", prior, np.linalg.solve(surrogate.kernel("matern52", z, z, s) + sparse.JITTER * np.eye(15), prior.T))
        got = (process.posterior(at)[1] / process.scale) ** 2
        assert np.all(got >= lost - 1e-9) and process.bound() == pytest.approx(bound, rel=1e-6)
        means, covariance = process.joint(at.reshape(10, 2, 2))
        assert means.ravel() == pytest.approx(mean, abs=1e-6) and np.sqrt(np.einsum("rii->ri", covariance)).ravel() == pytest.approx(process.posterior(at)[1], abs=1e-6)
        more = process.with_point(at[:1], 3.0)
        assert more.posterior(at[:1])[0] == pytest.approx(dense(np.vstack([x, at[:1]]), np.append(y, 3.0), z, s, 0.05, at[:1], "matern52")[0], abs=1e-6)
    fitted = sparse.fit(df, ["a", "b"], "out", [(0, 10), (0, 1)], inducing=20, rounds=2, tries=3)
    assert np.abs(fitted.posterior(x)[0] - np.sin(4 * x[:, 0]) - x[:, 1]).mean() < 0.1
    assert sparse.fit(df.where("false"), ["a", "b"], "out", [(0, 10), (0, 1)], inducing=4) is None


def test_variance_reduction_equals_all_pairs(spark):
    rng = np.random.default_rng(5)
    x, z, pool = rng.random((80, 2)), rng.random((9, 2)), rng.random((40, 2))
    seen = spark.createDataFrame([(*map(float, r), float(r.sum())) for r in x], "a double, b double, out double").repartition(3)
    s = np.array([0.4, 0.6])
    (found,) = sparse.gram_sums(seen, ["a", "b"], "out", [(0, 1)] * 2, z, "rbf", [s])
    process = sparse.SparseProcess(z, "rbf", s, 0.1, found)
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(pool)] + [(99, None, 0.1)], "id long, a double, b double").repartition(3)
    got = {r.id: r.reduction for r in sparse.variance_reduction(df, process, ["a", "b"], [(0, 1)] * 2).collect()}
    k = surrogate.kernel("rbf", z, pool, s)
    inner = np.linalg.inv(surrogate.kernel("rbf", z, z, s) + sparse.JITTER * np.eye(9) + found.gram / 0.1)
    covariance = k.T @ inner @ k
    for j in range(40):
        variance = (process.posterior(pool[j : j + 1])[1][0] / process.scale) ** 2
        assert got[j] == pytest.approx(process.scale**2 * np.mean(covariance[:, j] ** 2) / (variance + 0.1), rel=1e-5)
    assert got[99] is None


def test_matrix_sums(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 3).alias("b")).repartition(13)
    for fan_in in (2, 64):
        total, n = sums.matrix_sums(rows, lambda m: [m.T @ m, np.array([float(len(m))])], [(2, 2), (1,)], tasks_per_core=2, fan_in=fan_in)
        a = np.arange(1000.0)
        assert n[0] == 1000 and total == pytest.approx(np.array([[a @ a, a @ (a % 3)], [a @ (a % 3), (a % 3) @ (a % 3)]]))
    assert sums.matrix_sums(rows.where("false"), lambda m: [m.T @ m], [(2, 2)])[0].tolist() == [[0, 0], [0, 0]]


# --- kernel regression, committees, core-sets ------------------------------------------------


@pytest.mark.parametrize("how", [{}, {"candidate_rows": 5, "observation_rows": 7}])
def test_kernel_sums_equal_plain_version(spark, how):
    rng = np.random.default_rng(1)
    x, y, at = rng.integers(0, 6, (60, 2)) / 5, rng.standard_normal(60), rng.random((20, 2))
    seen = spark.createDataFrame([(k, *map(float, p), float(v)) for k, (p, v) in enumerate(zip(x, y, strict=True))] + [(100, None, 0.5, 1.0), (101, 0.5, 0.5, None)], "id long, a double, b double, out double").repartition(3)
    asked = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)] + [(50, None, 0.1), (0, *map(float, at[0]))], "key long, a double, b double").repartition(2)
    found = {r.key: r for r in kernel_stats.kernel_sums(asked, seen, "key", ["a", "b"], "out", 3.0, members=2, row_id="id", **how).collect()}
    import hashlib

    draw = lambda b, i: int(hashlib.md5(f"0:member/{b}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    poisson = lambda u: next((k for k in range(8) if u < sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))), 8)
    weights = np.array([[1.0] * 60, *[[poisson(draw(b, i)) for i in range(60)] for b in range(2)]])
    assert sorted(found) == list(range(20)) and 0.6 < weights[1:].mean() < 1.4
    for k, p in enumerate(at):
        w = np.exp(-3.0 * ((x - p) ** 2).sum(1)) * weights
        for name, values in (("n", np.ones(60)), ("total", y), ("square", y * y)):
            assert found[k][name] == pytest.approx((w @ values).tolist())
    assert kernel_stats.kernel_sums(asked, seen.where("false"), "key", ["a", "b"], "out", 3.0).where("n[0] <> 0").count() == 0


def test_conjugate_update_equals_one_observation_at_a_time(spark):
    prior = kernel_stats.NormalPrior(1.0, 2.0, 0.5, 3.0)
    m, k, v, f = prior.mean, prior.mean_weight, prior.variance, prior.freedom
    ys = [2.0, -1.0, 0.3, 4.0]
    for y in ys:  # the textbook update for a single observation
        v = (f * v + k / (k + 1) * (y - m) ** 2) / (f + 1)
        m, k, f = (k * m + y) / (k + 1), k + 1, f + 1
    row = spark.range(1).select(*prior.posterior(F.lit(4.0), F.lit(sum(ys)), F.lit(sum(y * y for y in ys)))).first()
    assert row[0] == pytest.approx(m) and row[1] == pytest.approx(v * (k + 1) / k * f / (f - 2)) and row[2] == f


@pytest.mark.parametrize("part_rows", [100_000, 300, 90])
def test_spread_choice_covers_within_the_proved_factor(spark, part_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 5)) * 10
    x = np.vstack([centres[k % 30] + rng.standard_normal(5) for k in range(2000)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [1.0]), (None, [0.0] * 5), (5002, [float("nan")] * 5)] + [(7, x[7].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    found = coresets.spread_choice(df.repartition(5), 40, "v", "id", part_rows=part_rows).orderBy("rank").collect()
    again = coresets.spread_choice(df.repartition(2), 40, "v", "id", part_rows=part_rows).orderBy("rank").collect()
    assert [r.id for r in found] == [r.id for r in again] and [r.rank for r in found] == list(range(1, 41))
    radius = lambda chosen: np.sqrt(((x[:, None] - chosen[None]) ** 2).sum(-1).min(1)).max()
    exact = x[coresets.farthest_first(x, 40, np.zeros((0, 5)))[0]]
    # the exact choice is within twice the least radius, so that the least is at least half of its; four times the least is the bound
    assert radius(np.array([r.v for r in found])) <= 4 * radius(exact) and radius(exact) > 0
    known = x[:3].tolist()
    away = coresets.spread_choice(df, 5, "v", "id", known=known, part_rows=part_rows).orderBy("rank").collect()
    assert away[0].distance == pytest.approx(np.sqrt(((x[:, None] - x[None, :3]) ** 2).sum(-1).min(1)).max()) and not {0, 1, 2} & {r.id for r in away}
    assert coresets.spread_choice(df.where("false"), 3, "v", "id").count() == 0 and coresets.spread_choice(df.where("id < 2"), 3, "v", "id").count() == 2


def test_spread_choice_of_the_standard_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(rows["embedding"]).astype(float)
    found = coresets.spread_choice(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 200, "embedding", "vec_id", part_rows=1000).toPandas()
    gap = lambda chosen: np.sqrt(np.maximum(((x * x).sum(1)[:, None] + (chosen * chosen).sum(1)[None] - 2 * x @ chosen.T).min(1), 0)).max()
    exact = gap(x[coresets.farthest_first(x, 200, np.zeros((0, 64)))[0]])
    assert len(found) == 200 and found["vec_id"].is_unique and exact / 2 <= gap(np.stack(found["embedding"])) <= 4 * exact


# --- joint choices and hyperparameters ----------------------------------------------------------


def small_process():
    x = np.array([[0.1], [0.45], [0.9]])
    return surrogate.GaussianProcess.with_hyper(x, np.array([0.2, 1.0, 0.1]), "rbf", np.array([0.15]), 1e-3)


def test_joint_improvement_equals_quadrature():
    gp, pair = small_process(), np.array([[[0.3], [0.62]]])
    mean, covariance = gp.joint(pair)
    nodes, weights = np.polynomial.hermite_e.hermegauss(120)
    a, b = np.meshgrid(nodes, nodes, indexing="ij")
    draws = np.stack([a.ravel(), b.ravel()], axis=1) @ np.linalg.cholesky(covariance[0]).T + mean[0]
    want = (np.outer(weights, weights).ravel() * np.maximum(draws.max(1) - gp.best, 0)).sum() / (2 * math.pi)
    base = surrogate.normal_draws(1 << 13, 2)
    assert surrogate.joint_acquisition(gp, pair, base, "qEI")[0] == pytest.approx(want, rel=0.01)
    assert surrogate.joint_acquisition(gp, pair, base, "qLEI")[0] == pytest.approx(math.log(want), abs=0.02)
    one = np.array([[[0.62]]])
    sure = surrogate.acquisition("EI", *gp.posterior(one[0]), gp.best)[0]
    assert surrogate.joint_acquisition(gp, one, surrogate.normal_draws(1 << 13, 1), "qEI")[0] == pytest.approx(sure, rel=0.01)
    assert 0 < surrogate.joint_acquisition(gp, pair, base, "qPI")[0] < 1
    single = surrogate.acquisition("qUCB", *gp.posterior(one[0]), gp.best, 0.2)[0]
    assert surrogate.joint_acquisition(gp, one, surrogate.normal_draws(1 << 13, 1), "qUCB", 0.2)[0] == pytest.approx(single, rel=0.01)


def test_joint_choice_beats_greedy(spark):
    gp, candidates = small_process(), space.sobol_array(64, 1)
    base = surrogate.normal_draws(512, 3, 1)
    greedy = surrogate.optimized(gp, candidates, 3, "qEI")
    joint = surrogate.joint_optimized(spark, gp, candidates, 3, "qEI", restarts=4, raw=64, n_draws=128)
    value = lambda p: surrogate.joint_acquisition(gp, p[None], base, "qEI")[0]
    assert joint.shape == (3, 1) and (joint >= 0).all() and (joint <= 1).all() and value(joint) > 1.01 * value(greedy)


def test_chains_agree_with_quadrature(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/part.parquet").groupBy("p_size").agg(F.avg("p_retailprice").alias("y")).orderBy("p_size").toPandas()
    density = surrogate.HyperPosterior((rows[["p_size"]].to_numpy(float) - 1) / 49, rows["y"].to_numpy(float), "rbf", noise=0.5)
    draws = surrogate.hyper_chains(spark, density, chains=4, draws=800, warmup=300, seed=2)
    found = surrogate.split_r_hat(draws).first()
    theta = np.linspace(-8, 8, 1601)
    log_density = np.array([density(np.array([t]))[0] for t in theta])
    p = np.exp(log_density - log_density.max())
    p /= p.sum()
    mean = p @ theta
    sd = math.sqrt(p @ (theta - mean) ** 2)
    assert found["parameter"] == 0 and found["r_hat"] < 1.1 and abs(found["mean"] - mean) < 0.25 * sd and found["sd"] == pytest.approx(sd, rel=0.25)


@pytest.mark.parametrize("kernel", surrogate.KERNELS)
def test_slope_of_the_hyperparameters(kernel):
    rng = np.random.default_rng(4)
    density = surrogate.HyperPosterior(rng.random((12, 2)), rng.standard_normal(12), kernel)
    at = np.array([-1.0, -0.5, -3.0])
    numeric = [(density(at + 1e-5 * e)[0] - density(at - 1e-5 * e)[0]) / 2e-5 for e in np.eye(3)]
    assert density(at)[1] == pytest.approx(numeric, rel=5e-3, abs=0.2 if kernel == "matern12" else 2e-2)  # the roughest kernel has no slope at distance zero
    assert density(np.full(3, 40.0))[0] == -math.inf


def test_chain_samples_a_normal():
    draws = surrogate.hamiltonian_chain(lambda t: (-0.5 * float(((t - 1) / 2) @ ((t - 1) / 2)), -(t - 1) / 4), np.zeros(2), 4000, 300, 5)
    assert draws[:, :2].mean(0) == pytest.approx([1, 1], abs=0.25) and draws[:, :2].std(0) == pytest.approx([2, 2], abs=0.25)


@pytest.mark.parametrize("how", [{"inducing": 12}, {"fully_bayesian": True, "hyper_draws": 4}, {"model_failures": True}])
def test_sampler_with_each_model(spark, how):
    s = adaptive.BayesianOptimizationSampler([(0, 2), (0, 1)], ["x", "y"], budget=9, initial_samples=5, acquisition_batch_size=3, acquisition_function="qUCB", beta=0.01, restarts=2, raw_samples=64, seed=2, **how)
    seen = s.frame(spark, 0, 14).withColumn("output", -((F.col("x") - 1) ** 2) - (F.col("y") - 0.5) ** 2).withColumn("success", ~(F.col("x") > 1.6))
    points = s.propose(spark, seen, 1).collect()
    assert [r["sample"] for r in points] == [0, 1, 2] and all(0 <= r.x <= 2 and 0 <= r.y <= 1 for r in points)
    assert min(abs(r.x - 1) + abs(r.y - 0.5) for r in points) < 0.5


@pytest.mark.parametrize("name", sorted(adaptive.SCORES))
def test_strategies_that_score_the_pool(spark, name):
    s = adaptive.ActiveLearningSampler([(0, 1), (-1, 1)], 40, ["x", "y"], name, 120, batch_size=4, seed=2)
    seen = s.pool(spark).where("x < 0.3").withColumn("output", F.sin(4 * F.col("x")) + F.col("y")).withColumn("success", F.lit(True))
    picks = s.propose(spark, seen, 1).collect()
    assert len(picks) == 4 and all(r.x >= 0.3 for r in picks) and len({(r.x, r.y) for r in picks}) == 4
    assert picks == s.propose(spark, seen.repartition(3), 1).collect()
    if name != "QueryByCommittee":  # where nothing is known, most is to be learned
        assert max(r.x for r in picks) > 0.5


# --- streams ----------------------------------------------------------------------------------------


def test_batches_are_told_once_late_runs_apart_and_the_rest_expires(spark, tmp_path):
    schema = "batch long, ts timestamp, failed boolean"
    at = lambda s: f"2024-01-01 {s}"
    waves = [
        [(1, at("00:00:01"), False), (2, at("00:00:02"), True), (1, at("00:00:03"), True), (None, at("00:00:03"), True)],
        [(1, at("00:00:05"), None), (3, at("00:00:06"), False)],
        [(1, at("00:10:00"), True), (4, at("05:00:00"), False)],  # late for batch 1; the watermark passes the others' time
        [(4, at("05:00:01"), False), (5, at("05:00:02"), False)],
        [(6, at("05:00:03"), False)],
    ]
    found = []
    for k, rows in enumerate(waves):  # each wave starts the stream again from its checkpoint
        df = spark.createDataFrame(rows, "batch long, ts string, failed boolean").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/runs/wave{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/runs")
        out = run_to_end(batch_accounts(stream, 3, late="1 hour", wait_ms=3_600_000, keep_ms=86_400_000), str(tmp_path))
        found.append(sorted((r.batch, r.status, r.completed, r.failures) for r in out.collect()))
    assert found[0] == [] and found[1] == [(1, "complete", 3, 1)]
    assert (1, "late", 1, 1) in found[2]
    assert found[-1] == sorted([(1, "complete", 3, 1), (1, "late", 1, 1), (2, "expired", 1, 1), (3, "expired", 1, 0)])


# --- nested targets and table functions -----------------------------------------------------------------


def plain_target(payload, names):
    """The objective by precedence; lists of numbers count as their sum."""

    def number(v):
        if isinstance(v, list):
            return None if any(number(x) is None or isinstance(x, list) for x in v) else sum(map(number, v))
        try:
            return None if v is None or isinstance(v, dict) else float(v)
        except ValueError:
            return None

    def total(mapping):
        found = [number(mapping[n]) for n in names if n in mapping and number(mapping[n]) is not None]
        return sum(found) if found else None

    if (t := total(payload)) is not None:
        return t
    output = payload.get("output")
    if not isinstance(output, dict):
        return number(output)
    if (t := total(output)) is not None:
        return t
    leaves = [number(v) for v in output.values() if number(v) is not None]
    return sum(leaves) if leaves else None


def leaves(v):
    if isinstance(v, dict):
        return [x for w in v.values() for x in leaves(w)]
    if isinstance(v, list):
        return [x for w in v for x in leaves(w)]
    return [float(v)] if isinstance(v, (int, float)) and not isinstance(v, bool) else []


PAYLOADS = [
    {"d1": 2, "d2": 3.5, "output": 9}, {"d2": [1, 2], "output": 9}, {"output": 4}, {"output": "4.5"}, {"output": [1, 2.5]}, {"output": {"d1": 1, "d2": 2, "z": 100}},
    {"output": {"a": 1, "b": [2, 3], "c": "text", "d": {"deep": 9}}}, {"output": {"c": "x"}}, {"other": 1}, {}, {"output": None}, {"d1": None, "output": 3}, {"x": {"y": [{"z": 1}, 2, {"w": [[3]]}]}},
]


def test_targets_of_mappings(spark):
    rows = spark.createDataFrame([(k, json.dumps(p)) for k, p in enumerate(PAYLOADS)] + [(50, None), (51, "no json")], "id long, text string")
    for names in (["d1", "d2"], ["d1"]):
        found = {r.id: r.output for r in mappings.with_nested_target(rows, "text", names).collect()}
        assert found == {**{k: plain_target(p, names) for k, p in enumerate(PAYLOADS)}, 50: None, 51: None}
    deep = mappings.deep_sum(rows.select("id", F.try_parse_json("text").alias("v")), "id", "v")
    assert {r.id: r.output for r in deep.collect()} == {**{k: sum(leaves(p)) if leaves(p) else None for k, p in enumerate(PAYLOADS)}, 50: None, 51: None}


@pytest.mark.parametrize("sampler", [
    {"type": "GridSampler", "bounds": [[0, 1], [2, 5]], "num_samples": [3, 2], "parameters": ["a", "b"]}, {"type": "ArraySampler", "bounds": [[1, 5], [7, 8, 9]], "parameters": ["a", "b"]},
    {"type": "RandomSampler", "bounds": [[0, 1], [2, 5]], "budget": 5, "seed": 4, "parameters": ["a", "b"]},
])
def test_table_function_gives_the_samplers_points(spark, sampler):
    table_functions.register(spark)
    spark.createDataFrame([(1, "x"), (2, "y"), (None, None)], "k long, name string").createOrReplaceTempView("parents_of_test")
    found = spark.sql(f"SELECT * FROM sample_points(TABLE(parents_of_test) PARTITION BY (k), '{json.dumps(sampler)}')")
    points = samplers.make_sampler(sampler).batch(spark, 0).collect()
    assert found.columns == ["k", "name", "sample", "a", "b"]
    want = [(k, n, p["sample"], round(float(p.a), 12), round(float(p.b), 12)) for k, n in ((1, "x"), (2, "y"), (None, None)) for p in points]
    assert sorted(((r.k, r["name"], r["sample"], round(r.a, 12), round(r.b, 12)) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_programs_files_are_not_kept_in_stores_that_only_spark_reaches(tmp_path):
    def config(base, save):
        runners = {"r": {"type": "ExampleProcessRunner", "sleep_sec": 0}}
        return {"samplers": {"s": {"type": "ArraySampler", "bounds": [[1]], "parameters": ["c1"]}}, "runners": runners, "supervisor": {"base_run_dir": base, "run_order": [{"sampler": "s", "runner": "r"}], "save_files": save}}

    with pytest.raises(ValueError, match="mount"):
        parse(config("hdfs://somewhere/x", "all"))
    assert parse(config("hdfs://somewhere/x", "none")).levels[0].runners[0].keep == "none"
    assert parse(config(f"file://{tmp_path}", "all")).levels[0].runners[0].keep_dir == f"{tmp_path}/runs"


# --- registered queries without SQL, against plain formulas ---------------------------------------------------


def test_process_queries_equal_the_dense_formulas(spark):
    from trialweave.plans.queries import QUERIES, _fitted

    sf = "/root/testdata/sf0.001"
    gp, best, _ = _fitted(spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet").toPandas()
    at = np.column_stack([(parts["p_size"] - 1) / 49, (parts["p_retailprice"] - 900) / 100]).astype(float)
    d = lambda a, b: np.sqrt((((a[:, None] - b[None]) / gp.scales) ** 2).sum(-1))
    k = lambda a, b: (1 + math.sqrt(3) * d(a, b)) * np.exp(-math.sqrt(3) * d(a, b))
    inner = k(gp.x, gp.x) + (gp.noise + 1e-8) * np.eye(len(gp.x))
    mean = gp.y.mean() + gp.y.std(ddof=1) * k(at, gp.x) @ np.linalg.solve(inner, (gp.y - gp.y.mean()) / gp.y.std(ddof=1))
    sd = gp.y.std(ddof=1) * np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", k(at, gp.x), np.linalg.solve(inner, k(gp.x, at))), 1e-12))
    found = QUERIES["gp_posterior"](spark, sf).toPandas().set_index("p_partkey").loc[parts["p_partkey"]]
    assert found["mean"].to_numpy() == pytest.approx(mean, abs=1e-6) and found["sd"].to_numpy() == pytest.approx(sd, abs=1e-4)
    z = (mean - best) / sd
    value = sd * (z * 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2))) + np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi))
    top = QUERIES["expected_improvement"](spark, sf).collect()
    assert [r.acquisition for r in top] == pytest.approx(sorted(value, reverse=True)[:20], rel=1e-2, abs=1e-6)


def test_query_of_the_sparse_process_predicts_what_it_saw(spark):
    from trialweave.plans.queries import QUERIES

    found = QUERIES["sparse_process"](spark, "/root/testdata/sf0.001").toPandas()
    want = np.sin(3 * found["x"]) + found["y"] ** 2
    assert len(found) > 50 and np.abs(found["mean"] - want).max() < 0.1 and (found["sd"] > 0).all()


def test_rounds_of_the_samplers(spark):
    from trialweave.plans.queries import QUERIES

    picks = QUERIES["bo_round"](spark, "/root/testdata/sf0.001").collect()
    assert len(picks) == 5 and all(0 <= r.x <= 1 and 0 <= r.y <= 1 for r in picks) and len({(r.x, r.y) for r in picks}) == 5
    # active learning, pick by pick, from the distances to everything known
    s = adaptive.ActiveLearningSampler([(0, 1), (0, 1)], 40, ["x", "y"], "GreedySamplingTarget", 500, batch_size=4, seed=2)
    from trialweave.operators.runners import SyntheticDoubleGaussianRunner

    seen = SyntheticDoubleGaussianRunner(2).apply(s.batch(spark, 0), ["x", "y"]).select("x", "y", "output").toPandas().sort_values(["x", "y", "output"])
    pool = s.pool(spark).orderBy("cand_id").toPandas()
    x, y = seen[["x", "y"]].to_numpy(), seen["output"].to_numpy()
    model, at, want = surrogate.KernelRegression.fit(x, y, seed=2), pool[["x", "y"]].to_numpy(), []
    for _ in range(4):
        gap = np.sqrt(((at[:, None] - x[None]) ** 2).sum(-1)) * np.abs(model.predict(at)[:, None] - y[None])
        score = gap.min(1)
        score[want] = -1
        best = int(score.argmax())
        want.append(best)
        x, y = np.vstack([x, at[best]]), np.append(y, model.predict(at[best : best + 1]))
    found = QUERIES["active_learning_round"](spark, "/root/testdata/sf0.001").orderBy("sample").collect()
    assert [(r.x, r.y) for r in found] == [tuple(at[k]) for k in sorted(want)]
