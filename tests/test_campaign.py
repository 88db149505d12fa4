"""Samplers, runners, the store and whole campaigns: contracts, failures, resuming and extending."""

import math

import pytest
from pyspark.sql import functions as F

from trialweave.operators import adaptive, samplers
from trialweave.operators.runners import ExampleRunner, FunctionRunner, ProcessRunner, SumRunner, SyntheticDoubleGaussianRunner, checked_sleep, last_two
from trialweave.operators.surrogate import ACQUISITIONS, KERNELS, GaussianProcess, KernelRegression, acquisition, propose
from trialweave.plans.config import parse
from trialweave.plans.engine import Engine, run_campaign, run_sequence
from trialweave.plans.progress import all_done
from trialweave.sources import files, scans, sinks
from trialweave.sources.store import Store


def config(tmp_path, levels, samplers_, runners, mode="fresh", **supervisor):
    return {"samplers": samplers_, "runners": runners, "supervisor": {"base_run_dir": str(tmp_path), "run_mode": mode, "run_order": levels} | supervisor}


SUM = {"type": "SumRunner", "params_to_sum": ["c1", "c2"]}


# --- samplers ---


def test_array_order_and_limits(spark):
    s = samplers.ArraySampler([[5, 7, 77, 199], [0.02, 0.2]], ["a", "b"], batch_size=3)
    assert [tuple(r) for r in s.batch(spark, 0).orderBy("sample").collect()] == [(0, 5, 0.02), (1, 5, 0.2), (2, 7, 0.02)]
    assert s.budget == 8 and s.batch(spark, 2).count() == 2 and s.batch(spark, 3) is None
    with pytest.raises(ValueError, match="array sampling"):
        samplers.ArraySampler([list(range(11))] * 11, [f"x{k}" for k in range(11)])
    with pytest.raises(ValueError, match="grid search"):
        samplers.GridSampler([(0, 1)] * 11, 11, [f"p{k}" for k in range(11)])


def test_grid_of_one_point(spark):
    assert samplers.GridSampler([(3, 9)], 1, ["x"]).batch(spark, 0).first()["x"] == 3.0


def test_random_batches_are_full_and_repeatable(spark):
    s = samplers.RandomSampler([(0, 1), (10, 20)], 10, ["x", "y"], batch_size=4, seed=1)
    rows = s.batch(spark, 2).collect()
    assert len(rows) == 4 and all(0 <= r.x < 1 and 10 <= r.y < 20 for r in rows)
    assert sorted(rows) == sorted(s.batch(spark, 2).repartition(3).collect())
    assert s.batch(spark, 3) is None
    with pytest.raises(ValueError):
        samplers.RandomSampler([(0, 1)], 1, ["x"], distribution="other")


def test_latin_hypercube_has_one_point_per_stratum(spark):
    s = samplers.LatinHypercubeSampler([(0, 1), (0, 1)], 130, ["x", "y"], batch_size=50)
    together = {r["sample"]: (r.x, r.y) for r in s.frame(spark, 0, 130).collect()}
    for k, n in enumerate([50, 50, 30]):
        rows = s.batch(spark, k).collect()
        for p in "xy":
            assert sorted(math.floor(r[p] * n) for r in rows) == list(range(n))
        # a batch is the same alone as with others
        assert all(together[50 * k + r["sample"]] == (r.x, r.y) for r in rows)
    one = samplers.LatinHypercubeSampler([(0, 1)], 1, ["x"]).batch(spark, 0).first()
    assert 0 <= one["x"] < 1


@pytest.mark.parametrize("n", [1, 2, 3, 1000, (1 << 20) + 3])
def test_permutations_are_whole_at_any_size(spark, n):
    """At every size all numbers come once; neighbours and batches part ways."""
    from trialweave.functions.random import permuted

    many = F.lit(n).cast("long")
    rows = spark.range(n).select("id", *[permuted(F.col("id"), many, 5, "x", F.lit(b).cast("long")).alias(f"p{b}") for b in (0, 1)])
    found = rows.agg(F.min("p0"), F.max("p0"), F.sum("p0"), F.count_distinct("p0"), F.corr("id", "p0"), F.corr("p0", "p1")).first()
    assert found[:4] == (0, n - 1, n * (n - 1) // 2, n)
    if n >= 1000:
        assert abs(found[4]) < 0.15 and abs(found[5]) < 0.15


def test_sobol_rounds_down_and_shifts(spark):
    s = samplers.SobolSequenceSampler([(0, 1)] * 16, 10, [f"p{k}" for k in range(16)], scramble=False)
    assert s.budget == 8
    rows = s.batch(spark, 0).orderBy("sample").collect()
    assert [(r.p0, r.p1) for r in rows] == [(0, 0), (0.5, 0.5), (0.75, 0.25), (0.25, 0.75), (0.375, 0.375), (0.875, 0.875), (0.625, 0.125), (0.125, 0.625)]
    for k in range(16):  # each dimension alone is a permutation of the eighths
        assert sorted(r[f"p{k}"] * 8 for r in rows) == list(range(8))
    moved = samplers.SobolSequenceSampler([(0, 1)], 8, ["x"]).batch(spark, 0).collect()
    assert sorted(math.floor(r.x * 8) for r in moved) == list(range(8))


def test_nested_later_sampler_wins(spark):
    a = {"type": "grid_sampler", "bounds": [[0, 1], [0, 1]], "num_samples": 2, "parameters": ["c1", "c2"]}
    b = {"type": "ArraySampler", "bounds": [[7.0, 8.0]], "parameters": ["c2"]}
    s = samplers.make_sampler({"type": "NestedSampler", "samplers": {"a": a, "b": b}})
    rows = [tuple(r) for r in s.batch(spark, 0).orderBy("sample").collect()]
    assert len(rows) == 8 and rows[:2] == [(0, 0.0, 7.0), (1, 0.0, 8.0)]
    with pytest.raises(NotImplementedError):
        s.batch(spark, 1)


def test_registry_names():
    assert samplers.SAMPLERS.find("random_sampler") is samplers.SAMPLERS.find("RandomSampler")
    assert samplers.SAMPLERS.find("trialweave.operators.samplers:GridSampler") is samplers.GridSampler
    with pytest.raises(ValueError):
        samplers.SAMPLERS.find("nothing")


def test_nested_counts():
    s = samplers.NestedSampler({k: samplers.ArraySampler([[0] * n], [k]) for k, n in (("a", 2), ("b", 3), ("c", 4))})
    assert s.runs_by_depth == [2, 6, 24] and s.total_runs == 32


# --- runners ---


def test_sum_and_gaussian(spark):
    df = spark.createDataFrame([(0, 3.0, 7.0, 0.5, 0.5)], "sample long, c1 double, c2 double, x double, y double")
    assert SumRunner(["c1", "c2"]).apply(df, []).first()["output"] == 10.0
    assert SyntheticDoubleGaussianRunner(1, [0, 1, 1, 0, 0, 1, 0]).apply(df.withColumn("x", F.lit(1.0)), []).first()["output"] == pytest.approx(math.exp(-1))
    with pytest.raises(ValueError):
        SyntheticDoubleGaussianRunner(3)
    with pytest.raises(KeyError):
        SyntheticDoubleGaussianRunner(2).apply(df.drop("y"), [])


def test_example_runner(spark):
    df = spark.createDataFrame([(0, "3", "7"), (1, "x", "1")], "sample long, c1 string, c2 string")
    rows = ExampleRunner().apply(df, []).orderBy("sample").collect()
    assert rows[0]["output"] == 10.0 and rows[1]["success"] is False and rows[1]["output"] is None
    assert not ExampleRunner(fail_prob=1.0).apply(df, []).where("success").count()
    assert last_two(["c1", "c10", "c9", "d2"]) == ["c10", "c9"]
    assert checked_sleep([0.1, 0.2]) == (0.1, 0.2)
    for bad, error in (([1], ValueError), ([2, 1], ValueError), ("1", TypeError)):
        with pytest.raises(error):
            checked_sleep(bad)


def test_function_runner_contract(spark, tmp_path):
    def f(run_dir, p):
        if p["c1"] == 1:
            raise RuntimeError("no")
        if p["c1"] == 2:
            return {"output": 1.0}
        if p["c1"] == 3:
            return {"output": 5.0, "success": False}
        with open(f"{run_dir}/kept.txt", "w") as file:
            file.write("x")
        return {"output": 9.0, "success": True, "extra": 4}

    df = spark.createDataFrame([(k, k) for k in range(4)], "sample long, c1 long")
    runner = FunctionRunner(f, {"extra": "long"}, keep="custom", keep_files=["kept.txt"], keep_dir=str(tmp_path), name="f")
    rows = run_sequence(df, [runner]).orderBy("sample").collect()
    assert [r["success"] for r in rows] == [True, False, False, False]
    assert rows[0]["output"] == 9.0 and rows[0]["extra"] == 4 and rows[1]["error_f"] == "RuntimeError: no" and rows[3]["output"] is None
    assert [p.name for p in tmp_path.iterdir()] == ["d0_b0_s0_r0"]


def test_process_runner(spark):
    df = spark.createDataFrame([(0, 3.0, 4.0), (1, None, 1.0)], "sample long, c1 double, c2 double")
    rows = ProcessRunner(name="p").apply(df, ["c1", "c2"]).orderBy("sample").collect()
    assert rows[0]["output"] == 7.0 and rows[1]["success"] is False


def test_input_files_are_written_first(spark):
    def write(params, folder):
        with open(f"{folder}/in.txt", "w") as file:
            file.write(str(params["c1"] * 2))

    df = spark.createDataFrame([(0, 3.0)], "sample long, c1 double")
    assert ProcessRunner(["cat", "in.txt"], write_input=write, name="p").apply(df, ["c1"]).first()["output"] == 6.0


def test_datapoint_columns(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0)], "sample long, c1 double, c2 double")
    one = run_sequence(df, [SumRunner(["c1", "c2"], name="r1")])
    assert one.columns == ["depth", "batch", "sample", "output", "success", "success_r1", "c1", "c2", "runtime_sec_r1", "run_dir"]
    two = run_sequence(df, [SumRunner(["c1", "c2"], name="r1"), SumRunner(["output"], name="r2")])
    assert two.columns == ["depth", "batch", "sample", "output", "success", "success_r2", "success_r1", "c1", "c2", "runtime_sec_r1", "runtime_sec_r2", "run_dir"]
    assert two.first()["run_dir"] == "d0_b0_s0_r1"


# --- campaigns ---


def test_nested_sequential_campaign(spark, tmp_path):
    point = lambda a, b: {"type": "RandomSampler", "bounds": [[a, a], [b, b]], "parameters": ["c1", "c2"], "budget": 10, "batch_size": 5}
    runners = {"r1": SUM, "r2": SUM | {"params_to_sum": ["output", "c1", "c2"]}}
    out = run_campaign(spark, config(tmp_path, [{"sampler": "a", "runner": ["r1", "r2"]}, {"sampler": "b", "runner": ["r1", "r2"]}], {"a": point(5, 1), "b": point(3, 2)}, runners, summary_datatype="parquet"))
    assert out.count() == 100 and {r.output for r in out.collect()} == {10.0}
    assert out.select("run_dir").distinct().count() == 100
    assert spark.read.parquet(f"{tmp_path}/dataset_parquet").count() == 100
    assert scans.summary(spark, f"{tmp_path}/dataset_csv", out.schema).count() == 100
    assert files.read_text(spark, f"{tmp_path}/all_progress.txt").count("\n") == 4


def test_failures_go_on_to_the_next_level(spark, tmp_path):
    s = {"a": {"type": "array_sampler", "bounds": [[1, 2, 1, 3]], "parameters": ["c1"]}, "b": {"type": "array_sampler", "bounds": [[1, 3, 1]], "parameters": ["c2"]}}
    r = {"r1": {"type": "SumRunner", "params_to_sum": ["c1"], "fail_if": 2}, "r2": SUM | {"fail_if": 4}}
    out = run_campaign(spark, config(tmp_path, [{"sampler": "a", "runner": "r1"}, {"sampler": "b", "runner": "r2"}], s, r))
    found = out.agg(F.count("*"), F.count(F.when(~F.col("success_r1"), 1)), F.count(F.when(~F.col("success_r2"), 1))).first()
    assert tuple(found) == (12, 3, 4)
    assert out.where("not success and output is not null").count() == 0


def test_files_of_programs_are_kept_as_configured(spark, tmp_path, monkeypatch):
    (tmp_path / "scratch").mkdir()
    levels, s = [{"sampler": "s", "runner": "p"}], {"s": {"type": "array_sampler", "bounds": [[1, 2], [5]], "parameters": ["c1", "c2"]}}
    program = {"p": {"type": "process_runner", "command": ["sh", "-c", "echo x > other.txt; echo {c2}"]}}
    c = config(tmp_path / "run", levels, s, program, save_files="custom", save_files_list=["output.txt"], local_storage=str(tmp_path / "scratch"))
    assert {r.output for r in run_campaign(spark, c).collect()} == {5.0}
    kept = sorted(str(p.relative_to(tmp_path / "run/runs")) for p in (tmp_path / "run/runs").rglob("*.txt"))
    assert kept == ["d0_b0_s0_r0/output.txt", "d0_b0_s1_r0/output.txt"] and not list((tmp_path / "scratch").iterdir())


def test_resume_after_a_kill(spark, tmp_path):
    s = {"type": "RandomSamplerWithKill", "bounds": [[0, 1], [0, 1]], "parameters": ["c1", "c2"], "budget": 50, "batch_size": 10, "kill_after": 4}
    levels = [{"sampler": "s", "runner": "r"}]
    with pytest.raises(samplers.SamplerKilled):
        run_campaign(spark, config(tmp_path, levels, {"s": s}, {"r": SUM}))
    assert Store(spark, str(tmp_path)).level(0).count() == 40
    out = run_campaign(spark, config(tmp_path, levels, {"s": s | {"kill_after": None}}, {"r": SUM}, "resume"))
    fresh = run_campaign(spark, config(tmp_path / "other", levels, {"s": s | {"kill_after": None}}, {"r": SUM}))
    key = lambda df: sorted((r.batch, r.sample, r.c1, r.c2) for r in df.collect())
    assert out.count() == 50 and key(out) == key(fresh)


def test_extend_and_a_crash_between_data_and_record(spark, tmp_path):
    s = {"type": "RandomSampler", "bounds": [[0, 1], [0, 1]], "parameters": ["c1", "c2"], "budget": 15, "batch_size": 5}
    levels = [{"sampler": "s", "runner": "r"}]
    run_campaign(spark, config(tmp_path, levels, {"s": s}, {"r": SUM}))
    files.delete(spark, f"{tmp_path}/commits/d0_b2.json")  # as if the last record had not been written
    assert run_campaign(spark, config(tmp_path, levels, {"s": s}, {"r": SUM}, "resume")).count() == 15
    assert run_campaign(spark, config(tmp_path, levels, {"s": s}, {"r": SUM}, "extend"), {"s": 10}).count() == 25


def test_budget_overflow(spark, tmp_path):
    s = {"type": "RandomSampler", "bounds": [[0, 1], [0, 1]], "parameters": ["c1", "c2"], "budget": 10, "batch_size": 4}
    levels = [{"sampler": "s", "runner": "r"}]
    assert run_campaign(spark, config(tmp_path / "a", levels, {"s": s}, {"r": SUM})).count() == 8
    assert run_campaign(spark, config(tmp_path / "b", levels, {"s": s}, {"r": SUM}, overflow="truncate")).count() == 10


def test_nested_extension_redoes_children(spark, tmp_path):
    s = {"a": {"type": "RandomSampler", "bounds": [[0, 1]], "parameters": ["c1"], "budget": 3, "batch_size": 3}, "b": {"type": "RandomSampler", "bounds": [[0, 1]], "parameters": ["c2"], "budget": 3, "batch_size": 3}}
    levels = [{"sampler": "a", "runner": "r"}, {"sampler": "b", "runner": "r"}]
    assert run_campaign(spark, config(tmp_path, levels, s, {"r": SUM})).count() == 9
    assert run_campaign(spark, config(tmp_path, levels, s, {"r": SUM}, "extend"), {"b": 3}).count() == 18
    assert run_campaign(spark, config(tmp_path, levels, s, {"r": SUM}, "extend"), {"a": 3}).count() == 18


@pytest.mark.parametrize("strategy", ["GreedySamplingTarget", "GSx", "GSy", "RandomSampling"])
def test_active_learning_campaign(spark, tmp_path, strategy):
    s = {"type": "ActiveLearningSampler", "bounds": [[0, 1], [0, 1]], "parameters": ["x", "y"], "budget": 12, "batch_size": 4, "n_candidates": 60, "query_strategy": strategy}
    out = run_campaign(spark, config(tmp_path, [{"sampler": "s", "runner": "g"}], {"s": s}, {"g": {"type": "SyntheticDoubleGaussianRunner", "dimensions": 2}}))
    assert out.count() == 12 and out.select("x", "y").distinct().count() == 12
    pool = {(r.x, r.y) for r in adaptive.ActiveLearningSampler(**{k: v for k, v in s.items() if k != "type"}).pool(spark).collect()}
    assert all(((r.x, r.y) in pool) == (r.batch > 0) for r in out.collect())


def test_bayesian_optimization_improves(spark, tmp_path):
    s = {"type": "BayesianOptimizationSampler", "bounds": [[0, 1], [0, 1]], "parameters": ["x", "y"], "budget": 12, "initial_samples": 12, "acquisition_batch_size": 6, "raw_samples": 256, "seed": 1}
    out = run_campaign(spark, config(tmp_path, [{"sampler": "s", "runner": "g"}], {"s": s}, {"g": {"type": "SyntheticDoubleGaussianRunner", "dimensions": 2}}))
    first, later = (out.where(c).agg(F.max("output")).first()[0] for c in ("batch < 2", "batch >= 2"))
    assert out.count() == 24 and later > first
    with pytest.raises(ValueError):
        adaptive.BayesianOptimizationSampler([(0, 1)], ["x"], fully_bayesian=True, inducing=8)
    with pytest.raises(ValueError):
        adaptive.BayesianOptimizationSampler([(0, 1)], ["x"], acquisition_function="other")
    assert adaptive.BayesianOptimizationSampler([(0, 1)], ["x"], acquisition_batch_size=10, random_fraction=0.25).plan(3) == (2, 7)


def test_failure_model_keeps_away(spark):
    s = adaptive.BayesianOptimizationSampler([(0, 1)], ["x"], budget=8, initial_samples=5, acquisition_batch_size=8, model_failures=True, raw_samples=256)
    rows = [(k / 40, k / 40 if k < 20 else None, k < 20) for k in range(40)]  # the better half fails
    seen = spark.createDataFrame(rows, "x double, output double, success boolean")
    assert sum(r.x < 0.6 for r in s.propose(spark, seen, 5).collect()) >= 6


def test_bayesian_optimization_fits_every_observation(spark, monkeypatch):
    from trialweave.operators import surrogate

    fitted = []
    monkeypatch.setattr(surrogate.GaussianProcess, "fit", lambda x, y, *a, **k: fitted.append((x, y)))
    rows = spark.range(0, 4202, 1, 4).select((F.col("id") / 4202).alias("x"), F.when(F.col("id") % 2 == 1, F.col("id").cast("double")).alias("output"), (F.col("id") % 2 == 1).alias("success"))
    s = adaptive.BayesianOptimizationSampler([(0, 1)], ["x"], model_failures=True)
    s.fitted(rows)
    (x, y), (everything, failed) = fitted
    assert len(x) == 2101 and y.max() == 4201.0  # the incumbent is in the last row
    assert len(everything) == 4202 and failed.sum() == 2101
    s.fitted(rows.repartition(3))
    assert all((a == b).all() for one, two in zip(fitted[:2], fitted[2:], strict=True) for a, b in zip(one, two, strict=True))
    with pytest.raises(ValueError, match="max_observations"):
        adaptive.BayesianOptimizationSampler([(0, 1)], ["x"], max_observations=2000).fitted(rows)


def test_active_learning_measures_to_every_observation(spark):
    import numpy as np

    s = adaptive.ActiveLearningSampler([(0, 1)], 20, ["x"], "GSx", n_candidates=200, batch_size=1)
    # 5,000 rows near 0, and behind them rows that cover all but the surroundings of 0.4
    x = [k / 50_000 for k in range(5000)] + [v / 1000 for v in range(100, 1001) if abs(v - 400) > 50]
    seen = spark.createDataFrame([(v, v, True) for v in x], "x double, output double, success boolean").coalesce(1)
    pool = np.array([r.x for r in s.pool(spark).collect()])
    best = pool[np.abs(pool[:, None] - np.array(x)[None]).min(1).argmax()]
    assert [r.x for r in s.propose(spark, seen, 1).collect()] == [best] and abs(best - 0.4) < 0.05


def test_query_strategies_of_ones_own(spark):
    s = adaptive.ActiveLearningSampler([(0, 1)], 20, ["x"], "numpy:add", n_candidates=50, batch_size=2)  # the sum of both distances
    seen = spark.createDataFrame([(0.5, 1.0, True), (0.6, 2.0, True)], "x double, output double, success boolean")
    assert s.propose(spark, seen, 1).count() == 2
    with pytest.raises(ValueError, match="query strategy"):
        adaptive.ActiveLearningSampler([(0, 1)], 20, ["x"], "other")


@pytest.mark.parametrize("strategy", ["GSx", "GSy", "GSi"])
def test_greedy_picks_are_those_of_one_pass_each(spark, strategy):
    """Picking from the best rows of one pass gives what picking from the whole pool gives."""
    import numpy as np

    s = adaptive.ActiveLearningSampler([(0, 1), (0, 1)], 60, ["x", "y"], strategy, n_candidates=300, batch_size=40, seed=3)
    seen = SyntheticDoubleGaussianRunner(2).apply(s.batch(spark, 0), ["x", "y"])
    known = adaptive.gathered(adaptive.observations(seen, ["x", "y"]), None)
    pool = np.array([(r.cand_id, r.x, r.y) for r in s.pool(spark).orderBy("cand_id").collect()])
    x, out, model, want = known[["x", "y"]].to_numpy(float), known["output"].to_numpy(float), None, []
    model = KernelRegression.fit(x, out, seed=3)
    for _ in range(40):
        dx = np.sqrt(((pool[:, None, 1:] - x[None]) ** 2).sum(-1))
        dy = np.abs(model.predict(pool[:, 1:])[:, None] - out[None])
        value = {"GSx": dx, "GSy": dy, "GSi": dx * dy}[strategy].min(1)
        value[[int(k) for k in want]] = -1
        want.append(int(value.argmax()))
        x, out = np.vstack([x, pool[want[-1], 1:]]), np.append(out, model.predict(pool[want[-1], 1:][None]))
    found = s.propose(spark, seen, 1).collect()
    assert sorted((r.x, r.y) for r in found) == sorted(map(tuple, pool[want, 1:].tolist()))


def test_searches_refine_the_best_candidates():
    import numpy as np

    from trialweave.operators.surrogate import optimized

    x = np.linspace(0, 1, 15)[:, None]
    gp = GaussianProcess.fit(x, -((x[:, 0] - 0.437) ** 2), "rbf")
    raw = np.linspace(0, 1, 9)[:, None]
    best = lambda p: acquisition("qUCB", *gp.posterior(p), float(gp.y.max())).max()
    point = optimized(gp, raw, 1, "qUCB")
    assert best(point) >= best(raw) and abs(point[0, 0] - 0.437) < 0.05
    assert optimized(gp, raw, 3).shape == (3, 1)


def test_unlucky_programs(spark):
    from trialweave.operators.runners import ExampleProcessRunner

    df = spark.createDataFrame([(k, float(k), 1.0) for k in range(12)], "sample long, c1 double, c2 double")
    for raises in (True, False):
        rows = ExampleProcessRunner(fail_prob=0.5, raise_failures=raises, sleep_sec=0, name="e").apply(df, ["c1", "c2"]).collect()
        bad = [r for r in rows if not r["success"]]
        assert 0 < len(bad) < 12 and all((r["error_e"] is not None) == raises and r["output"] is None for r in bad)
        assert all(r["output"] == r["c1"] + 1 for r in rows if r["success"])
    with pytest.raises(ValueError):
        ExampleProcessRunner(fail_prob=2)


# --- models ---


@pytest.mark.parametrize("name", KERNELS)
def test_process_interpolates(name):
    import numpy as np

    x = np.linspace(0, 1, 12)[:, None]
    y = np.sin(6 * x[:, 0])
    gp = GaussianProcess.fit(x, y, name)
    mean, sd = gp.posterior(x)
    assert np.abs(mean - y).max() < 0.1 and sd.max() < 0.2
    for a in ACQUISITIONS:
        assert np.isfinite(acquisition(a, mean, sd, float(y.max()))).all()
    assert len(set(propose(gp, np.linspace(0, 1, 50)[:, None], 5).tolist())) == 5
    with pytest.raises(ValueError):
        acquisition("other", mean, sd, 0.0)


def test_kernel_regression():
    import numpy as np

    x = np.random.default_rng(0).random((200, 1))
    assert np.abs(KernelRegression.fit(x, x[:, 0], gamma=200.0).predict(np.array([[0.3], [0.7]])) - [0.3, 0.7]).max() < 0.1


# --- sources ---


def test_scans(spark, tmp_path):
    for name, text in (("d0_b0_s0_r0", "output,success,x\n1.5,True,2\n"), ("d0_b0_s1_r0", ""), ("d0_b0_s2_r0", "output,success,x\n"), ("d0_b0_s3_r0", 'x,note,success\r\noops,"a, b",false')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "datapoint.csv").write_text(text)
    rows = scans.datapoints(spark, str(tmp_path), "output double, success boolean, x double").collect()
    assert sorted(((r.output, r.success, r.x, r.run_dir) for r in rows), key=str) == [(1.5, True, 2.0, "d0_b0_s0_r0"), (None, False, None, "d0_b0_s3_r0")]
    assert [r.note for r in scans.datapoints(spark, str(tmp_path), "note string", name_filter="s3").collect()] == ["a, b"]
    assert scans.datapoints(spark, str(tmp_path / "none"), "output double").count() == 0
    assert scans.summary(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    assert all_done(spark.createDataFrame([(True,)], "success boolean")) and not all_done(spark.createDataFrame([(None,)], "success boolean"))


def test_hdf5_needs_its_library(spark, tmp_path):
    df = spark.createDataFrame([("r", 1.0, True)], "run_dir string, a double, b boolean")
    assert sinks.numeric(df).columns == ["a"]
    if __import__("importlib.util").util.find_spec("h5py") is None:
        with pytest.raises(RuntimeError):
            sinks.write_hdf5(df, str(tmp_path / "x.h5"))


@pytest.mark.parametrize("change", [{"run_order": []}, {"run_order": [{"sampler": "no", "runner": "r"}]}, {"run_mode": "other"}, {"base_run_dir": ""}])
def test_bad_configurations(tmp_path, change):
    good = config(tmp_path, [{"sampler": "s", "runner": "r"}], {"s": {"type": "array_sampler", "bounds": [[1]], "parameters": ["c1"]}}, {"r": SUM})
    good["supervisor"] |= change
    with pytest.raises(ValueError):
        parse(good)


def test_a_sampler_used_twice_has_its_own_state(spark, tmp_path):
    c = config(tmp_path, [{"sampler": "s", "runner": "r"}] * 2, {"s": {"type": "array_sampler", "bounds": [[1.0, 2.0]], "parameters": ["c1"]}}, {"r": SUM})
    engine = Engine(spark, parse(c))
    assert engine.run().count() == 4 and engine.progress().count() == 2


# --- streams ---


def test_stream_is_committed_once(spark, tmp_path):
    from trialweave.streaming.micro_batch import commit_stream, windowed_progress

    points = spark.range(10).select(F.col("id").alias("sample"), F.col("id").cast("double").alias("c1"))
    points.repartition(2).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
        q = commit_stream(stream, [SumRunner(["c1"], name="r")], Store(spark, str(tmp_path / "store")), str(tmp_path / "check"), feedback=lambda df, k: seen.append(k))
        q.awaitTermination()
    assert Store(spark, str(tmp_path / "store")).level(0).count() == 10 and seen == [0]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "ok"), ("2024-01-01 00:20:00", "error")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert tuple(windowed_progress(events).first())[1:] == (2, 1)
