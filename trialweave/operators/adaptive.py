"""Samplers that look at results: pool-based active learning and Bayesian optimization.

An exact model is fitted on the driver on every observation, in an order of
their values, so that reruns agree.  ``max_observations`` cuts nothing: where it
is set, more observations raise.  Sparse processes, committees and the conjugate
kernel regression leave observations where they are.  Candidate pools stay
DataFrames and are scored where they lie.
"""

from __future__ import annotations

import importlib
import logging
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import random as rnd
from ..functions import space
from ..sources import scans
from . import kernel_stats, sparse_process, surrogate
from .samplers import SAMPLERS, Sampler, SobolSequenceSampler

log = logging.getLogger(__name__)


def observations(results: DataFrame | None, parameters: Sequence[str], output: str = "output", extra: Sequence[Column] = ()) -> DataFrame | None:
    """Successful rows' parameters and output."""
    if results is None:
        return None
    return results.where(F.col("success") & F.col(output).isNotNull()).select(*parameters, F.col(output).cast("double").alias("output"), *extra)


def failures(results: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Parameters of the rows that did not succeed."""
    return results.where(~F.coalesce(F.col("success"), F.lit(False))).select(*parameters)


def gathered(rows: DataFrame, most: int | None) -> pd.DataFrame:
    """All of ``rows`` on the driver, ordered by their values; ValueError if there are more than ``most``."""
    found = (rows if most is None else rows.limit(most + 1)).toPandas()
    if most is not None and len(found) > most:
        raise ValueError(f"more than max_observations={most} rows; a model is fitted on all of them or not at all")
    return found.sort_values(list(found.columns), ignore_index=True)


def reduced_target(columns: Sequence[str], names: Sequence[str]) -> Column:
    """The objective: the sum of the named columns, or ``output`` if there are none; KeyError if neither exists."""
    there = [n for n in names if n in columns]
    if there:
        out = F.col(there[0]).cast("double")
        for n in there[1:]:
            out = out + F.col(n).cast("double")
        return out
    if "output" in columns:
        return F.col("output").cast("double")
    raise KeyError(f"none of {list(names)} and no output among {list(columns)}")


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def least_distance(vector: Column, known: Column) -> Column:
    """Euclidean distance from ``vector`` to the nearest of the array of vectors ``known``."""
    return F.sqrt(F.array_min(F.transform(known, lambda o: squared_distance(vector, o))))


#: name -> score of candidates from their distances (candidates x known) in inputs and in predicted outputs
STRATEGIES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray] | None] = {"GSx": lambda dx, dy: dx, "GSy": lambda dx, dy: dy, "GSi": lambda dx, dy: dx * dy, "RandomSampling": None}


def strategy(name: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """A query strategy by name, or one of one's own as "package.module:function"; None draws at random."""
    if ":" in name:
        module, _, attribute = name.partition(":")
        return getattr(importlib.import_module(module), attribute)
    name = {"GreedySamplingTarget": "GSi", "GreedySamplingX": "GSx"}.get(name, name)
    if name not in STRATEGIES:
        raise ValueError(f"unknown query strategy {name!r}; known: {sorted({*STRATEGIES, *SCORES})}")
    return STRATEGIES[name]


def _in_unit_cube(rows: DataFrame, parameters: Sequence[str], bounds: Sequence[Sequence[float]], *keep: Column) -> DataFrame:
    return rows.select(*[space.normalize(F.col(f"`{p}`").cast("double"), *b).alias(p) for p, b in zip(parameters, bounds, strict=True)], *keep)


def disagreement(pool: DataFrame, seen: DataFrame, parameters: Sequence[str], bounds: Sequence[Sequence[float]], seed: int = 0) -> DataFrame:
    """``pool`` (cand_id, parameters) with ``_score``: by how much five bootstrap members of a kernel regression on ``seen`` differ."""
    names = [f"`{p}`" for p in parameters]
    row = F.xxhash64(*names, "output")
    apart = seen.withColumn("_copy", F.row_number().over(Window.partitionBy(*names, "output").orderBy(F.lit(0))))  # repeated runs are drawn apart
    observed = _in_unit_cube(apart, parameters, bounds, F.col("output"), F.concat_ws(":", row.cast("string"), "_copy").alias("_id"))
    found = kernel_stats.committee_scores(_in_unit_cube(pool, parameters, bounds, F.col("cand_id")), observed, "cand_id", parameters, "output", 12.0 / len(parameters), "_id", prior=_prior(seen), seed=seed)
    return pool.join(found.select("cand_id", F.col("disagreement").alias("_score")), "cand_id")


def predictive_spread(pool: DataFrame, seen: DataFrame, parameters: Sequence[str], bounds: Sequence[Sequence[float]], seed: int = 0) -> DataFrame:
    """``pool`` with ``_score``: the predictive standard deviation of the conjugate kernel regression on ``seen``."""
    found = kernel_stats.kernel_regression(_in_unit_cube(pool, parameters, bounds, F.col("cand_id")), _in_unit_cube(seen, parameters, bounds, F.col("output")), "cand_id", parameters, "output", 12.0 / len(parameters), _prior(seen))
    return pool.join(found.select("cand_id", F.col("sd").alias("_score")), "cand_id")


def expected_reduction(pool: DataFrame, seen: DataFrame, parameters: Sequence[str], bounds: Sequence[Sequence[float]], seed: int = 0) -> DataFrame:
    """``pool`` with ``_score``: by how much a run there would lower the mean variance over the pool, by a sparse process on ``seen``."""
    process = sparse_process.fit(seen, parameters, "output", bounds, inducing=min(64, 16 * len(parameters)), rounds=2, seed=seed)
    return sparse_process.variance_reduction(pool, process, parameters, bounds, "_score")


def _prior(seen: DataFrame) -> kernel_stats.NormalPrior:
    """A prior worth a tenth of an observation, at the mean and variance of all outputs."""
    mean, variance = seen.agg(F.avg("output"), F.var_samp("output")).first()
    return kernel_stats.NormalPrior(mean or 0.0, variance=variance or 1.0)


#: name -> pool with scores, from all observations as a table: nothing is collected but the picks
SCORES: dict[str, Callable[..., DataFrame]] = {"QueryByCommittee": disagreement, "ExpectedVarianceReduction": expected_reduction, "PredictiveSpread": predictive_spread}


class ActiveLearningSampler(Sampler):
    """Greedy choice from a uniform pool drawn once.

    Without observations a batch is uniform points outside the pool.  Later,
    each pick has the greatest distance to what is known: in inputs (GSx), in
    predicted output (GSy), or the product of both (GSi, which
    "GreedySamplingTarget" stands for).  A strategy of one's own is a function
    "module:name" of the distances in inputs and in outputs (candidates x
    known); the least of its values over what is known is a candidate's score.
    QueryByCommittee, ExpectedVarianceReduction and PredictiveSpread score the
    pool by a model of all observations, which stay a table, and take the best.
    Chosen candidates leave the pool.
    """

    adaptive = True
    truncates = False

    def __init__(self, bounds, budget, parameters, query_strategy: str = "GreedySamplingTarget", n_candidates: int = 1000, batch_size=None, seed: int = 0, max_observations: int | None = None, **_: Any):
        super().__init__(bounds, parameters, budget, batch_size, seed)
        self.scores = SCORES.get(query_strategy)
        self.strategy = None if self.scores else strategy(query_strategy)
        self.fit_seed = int(seed)
        self.n_candidates, self.max_observations = n_candidates, max_observations

    def _points(self, spark: SparkSession, start: int, n: int, tag: str) -> DataFrame:
        values = [rnd.uniform(rnd.unit(self.seed, f"{tag}/{p}", F.col("id")), *b).alias(p) for p, b in zip(self.parameters, self.bounds, strict=True)]
        return spark.range(start, start + n).select(F.col("id").alias("sample"), *values)

    def pool(self, spark: SparkSession) -> DataFrame:
        """cand_id and the parameters of all candidates."""
        return self._points(spark, 0, self.n_candidates, "pool").withColumnRenamed("sample", "cand_id")

    def frame(self, spark: SparkSession, start: int, n: int) -> DataFrame:
        return self._points(spark, start, n, "start")

    def remaining(self, spark: SparkSession, results: DataFrame | None) -> DataFrame:
        """The pool without candidates that have been run, whatever came of them."""
        if results is None:
            return self.pool(spark)
        return self.pool(spark).join(results.select(*self.parameters).distinct(), self.parameters, "left_anti")

    def propose(self, spark: SparkSession, results: DataFrame | None, number: int) -> DataFrame | None:
        start, n = self.batch_range(number)
        if n <= 0:
            return None
        seen = observations(results, self.parameters)
        if self.scores and seen is not None and seen.limit(1).count():
            scored = self.scores(self.remaining(spark, results), seen, self.parameters, self.bounds, self.fit_seed + number)
            chosen = scored.orderBy(F.desc_nulls_last("_score"), "cand_id").limit(n)
            return chosen.select((F.row_number().over(Window.orderBy("cand_id")) - 1).cast("long").alias("sample"), *self.parameters)
        known = gathered(seen, self.max_observations) if seen is not None else None
        if known is None or known.empty:
            return self.batch(spark, number)
        pool = self.remaining(spark, results)
        if self.strategy is None:
            chosen = pool.orderBy(rnd.unit(self.seed, f"pick/{number}", F.col("cand_id"))).limit(n)
        else:
            chosen = self._greedy(spark, pool, known, n)
        return chosen.select((F.row_number().over(Window.orderBy("cand_id")) - 1).cast("long").alias("sample"), *self.parameters)

    def _greedy(self, spark: SparkSession, pool: DataFrame, known: pd.DataFrame, n: int) -> DataFrame:
        """Picks one after the other.

        A score is a least value over what is known, so that it only falls as
        points are picked.  One pass over the pool brings its best rows; while
        the best of them, scored anew, is above the last of them as it was, no
        other row can be better, and no further pass is needed.
        """
        x, y = known[self.parameters].to_numpy(float), known["output"].to_numpy(float)
        model, parameters, values = surrogate.KernelRegression.fit(x, y, seed=self.seed), self.parameters, self.strategy

        def scores(points: np.ndarray, have_x: np.ndarray, have_y: np.ndarray) -> np.ndarray:
            out = [np.zeros(0)]
            for part in surrogate.blocks(points, have_x):
                dx = np.sqrt(((part[:, None] - have_x[None]) ** 2).sum(-1))
                out.append(values(dx, np.abs(model.predict(part)[:, None] - have_y[None])).min(1))
            return np.concatenate(out)

        schema = T.StructType([*pool.schema.fields, T.StructField("_score", T.DoubleType())])
        picks: list[list] = []
        while len(picks) < n:
            have = x.copy(), y.copy()

            def score(batches: Iterator[pd.DataFrame], have=have) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    yield pdf.assign(_score=scores(pdf[parameters].to_numpy(float), *have))

            left = pool.where(~F.col("cand_id").isin([p[0] for p in picks])) if picks else pool
            held = 16 * (n - len(picks))
            best = left.mapInPandas(score, schema).orderBy(F.desc("_score"), "cand_id").limit(held + 1).toPandas()
            if best.empty:
                break
            bound = best["_score"].iloc[-1] if len(best) > held else -np.inf
            first = True
            while len(picks) < n and len(best):
                best = best.assign(_score=scores(best[parameters].to_numpy(float), x, y)).sort_values(["_score", "cand_id"], ascending=[False, True], ignore_index=True)
                if not first and best["_score"].iloc[0] <= bound:
                    break
                point = best.loc[[0], parameters].to_numpy(float)
                picks.append([int(best["cand_id"].iloc[0]), *point[0].tolist()])
                x, y, best, first = np.vstack([x, point]), np.append(y, model.predict(point)), best.iloc[1:], False
        return spark.createDataFrame(picks, "cand_id long, " + ", ".join(f"`{p}` double" for p in parameters))


class BayesianOptimizationSampler(Sampler):
    """Random points until ``initial_samples`` observations, then a Gaussian process and an acquisition function.

    Maximizes the output.  Initial batches do not count against the budget
    unless ``count_warmup``.  Synchronous batches have int(random_fraction * B)
    random points and max(int((1 - random_fraction) * B), 1) of the model;
    asynchronous ones a single point.  ``model_failures`` adds a second process
    on failed runs: a candidate passes with the probability of not failing, and
    a shortfall is filled with unfiltered ones.  The points of a batch are
    chosen together, by the acquisition of their joint outcome: the best of
    ``restarts`` local searches from the best of ``raw_samples`` sets of Sobol
    points, dealt over tasks; with a failure model they are filtered after that.

    The exact process is fitted on the driver.  With ``inducing`` points the
    process is a sparse one over all observations, which stay a table.
    ``fully_bayesian`` draws hyperparameters from their posterior in several
    chains, a task each, and averages ``hyper_draws`` processes.
    ``history`` is a folder of run directories with a datapoint.csv each, whose
    runs count as observations, but for those with a string of ``history_skip``
    in their names.
    """

    adaptive = True
    truncates = False

    def __init__(self, bounds, parameters, budget: int = 20, initial_samples: int = 50, acquisition_batch_size: int = 20, acquisition_function: str = "qLEI", kernel: str = "matern32", beta: float = 0.2, random_fraction: float = 0.0, asynchronous: bool = False, model_failures: bool = False, observations: Sequence[str] = ("output",), raw_samples: int = 1024, count_warmup: bool = False, fully_bayesian: bool = False, max_observations: int | None = None, restarts: int = 10, history: str | None = None, history_skip: Sequence[str] = (), inducing: int | None = None, hyper_draws: int = 8, seed: int = 0, **ignored: Any):
        super().__init__(bounds, parameters, budget, acquisition_batch_size, seed)
        if fully_bayesian and inducing:
            raise ValueError("hyperparameters are drawn for the exact process only; choose fully_bayesian or inducing")
        if acquisition_function not in surrogate.ACQUISITIONS:
            raise ValueError(f"unknown acquisition {acquisition_function!r}; known: {surrogate.ACQUISITIONS}")
        if kernel not in surrogate.KERNELS:
            raise ValueError(f"unknown kernel {kernel!r}; known: {surrogate.KERNELS}")
        self.initial, self.acquisition, self.kernel, self.beta = initial_samples, acquisition_function, kernel, beta
        self.random_fraction, self.asynchronous, self.model_failures = random_fraction, asynchronous, model_failures
        self.observed, self.raw_samples, self.count_warmup, self.max_observations = list(observations), raw_samples, count_warmup, max_observations
        self.restarts, self.history, self.history_skip = restarts, history, list(history_skip)
        self.inducing, self.fully_bayesian, self.hyper_draws = inducing, fully_bayesian, hyper_draws
        if ignored:
            log.debug("ignored options: %s", sorted(ignored))

    def with_history(self, spark: SparkSession, results: DataFrame | None) -> DataFrame | None:
        """``results`` and the runs of ``history`` that are not among them."""
        if not self.history:
            return results
        columns = dict.fromkeys([*self.parameters, *self.observed], "double") | {"success": "boolean"}
        found = scans.datapoints(spark, self.history, ", ".join(f"`{c}` {kind}" for c, kind in columns.items()))
        found = scans.unseen(found, results if results is not None and "run_dir" in results.columns else None, self.history_skip)
        return found if results is None else results.unionByName(found, allowMissingColumns=True)

    def frame(self, spark: SparkSession, start: int, n: int) -> DataFrame:
        values = [rnd.uniform(rnd.unit(self.seed, p, F.col("id")), *b).alias(p) for p, b in zip(self.parameters, self.bounds, strict=True)]
        return spark.range(start, start + n).select(F.col("id").alias("sample"), *values)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        low, high = np.array(self.bounds, float).T
        return (x - low) / (high - low)

    def plan(self, number: int) -> tuple[int, int]:
        """(random points, model points) of a batch after the initial phase."""
        if self.asynchronous:
            one = np.random.default_rng([self.seed, number]).random() < self.random_fraction
            return (1, 0) if one else (0, 1)
        b = self.batch_size
        return int(self.random_fraction * b), max(int((1 - self.random_fraction) * b), 1)

    def _process(self, rows: DataFrame, target: str, **how: Any):
        """A process over ``rows`` (parameters and ``target``); None without rows."""
        if self.inducing:
            return sparse_process.fit(rows, self.parameters, target, self.bounds, kernel_name=self.kernel, inducing=self.inducing, seed=self.seed)
        found = gathered(rows.select(*self.parameters, target), self.max_observations)
        if found.empty:
            return None
        x, y = self._unit(found[self.parameters].to_numpy(float)), found[target].to_numpy(float)
        if not how.get("bayesian"):
            return surrogate.GaussianProcess.fit(x, y, self.kernel, seed=self.seed)
        density = surrogate.HyperPosterior(x, y, self.kernel)
        draws = surrogate.hyper_chains(rows.sparkSession, density, chains=4, draws=100, warmup=150, seed=self.seed)
        taken = draws.where(F.col("draw") % max(1, 400 // self.hyper_draws) == 0).orderBy("chain", "draw").select("theta").collect()
        return surrogate.Mixture.of_draws(density, np.array([r["theta"] for r in taken]))

    def fitted(self, results: DataFrame | None):
        """The process over successful rows, and that over failures (0 or 1) where they are modelled; None for what has no rows."""
        if results is None:
            return None, None
        target = reduced_target(results.columns, self.observed)
        good = observations(results.withColumn("_target", target), self.parameters, "_target")
        failed = failures(results, self.parameters).withColumn("failed", F.lit(1.0)) if self.model_failures else None
        gp = self._process(good, "output", bayesian=self.fully_bayesian)
        if failed is None or not failed.limit(1).count():
            return gp, None
        return gp, self._process(good.select(*self.parameters, F.lit(0.0).alias("failed")).unionByName(failed), "failed")

    def _chosen(self, spark: SparkSession, gp, chance, raw: np.ndarray, n: int, number: int) -> np.ndarray:
        """``n`` points of the unit cube, chosen together; with a model of failures those of them that pass, and the best of ``raw`` that do.

        Only where too few of ``raw`` pass as well do points stay that did not.
        """
        found = surrogate.joint_optimized(spark, gp, raw, n, self.acquisition, self.beta, restarts=self.restarts, seed=self.seed + number)
        if chance is None:
            return found
        rng = np.random.default_rng([self.seed, number, 1])
        passes = lambda x: rng.random(len(x)) > np.clip(chance.posterior(x)[0], 0, 1)
        good = passes(found)
        passed, refused, others = found[good], found[~good], raw[passes(raw)]
        if len(passed) < n and len(others):
            for point in passed:  # what comes next is chosen with these believed to come out at their means
                gp = gp.with_point(point[None], float(gp.posterior(point[None])[0][0]))
            passed = np.vstack([passed, others[surrogate.propose(gp, others, n - len(passed), self.acquisition, self.beta)]])
        return np.vstack([passed, refused[: n - len(passed)]])

    def propose(self, spark: SparkSession, results: DataFrame | None, number: int, spent: int = 0) -> DataFrame | None:
        """The next batch; ``spent`` is how much of the budget earlier batches have used."""
        if spent >= self.budget:
            return None
        results = self.with_history(spark, results)
        n_seen = observations(results.withColumn("_target", reduced_target(results.columns, self.observed)), self.parameters, "_target").count() if results is not None else 0
        start = number * self.batch_size
        if n_seen < self.initial:
            return self.frame(spark, start, self.batch_size).withColumn("sample", F.col("sample") - start)
        n_random, n_model = self.plan(number)
        gp, chance = self.fitted(results)
        if gp is None:
            raise RuntimeError("the model has no observations")
        points = [[float(r[p]) for p in self.parameters] for r in self.frame(spark, start, n_random).collect()] if n_random else []
        if n_model:
            cube = SobolSequenceSampler([(0.0, 1.0)] * len(self.parameters), self.raw_samples, self.parameters, seed=self.seed + number)
            raw = np.array([[r[p] for p in self.parameters] for r in cube.frame(spark, 0, cube.budget).collect()], float)
            best = self._chosen(spark, gp, chance, raw, n_model, number)
            low, high = np.array(self.bounds, float).T
            points += (low + best * (high - low)).tolist()
        schema = "sample long, " + ", ".join(f"`{p}` double" for p in self.parameters)
        return spark.createDataFrame([[k, *p] for k, p in enumerate(points)], schema)


def score_pool(pool: DataFrame, gp: surrogate.GaussianProcess, parameters: Sequence[str], bounds: Sequence[Sequence[float]], name: str = "qLEI", beta: float = 0.2, best: float | None = None) -> DataFrame:
    """``pool`` with posterior mean, sd and acquisition of every row; the fitted process goes to the rows.

    ``best`` is the incumbent where the process was fitted on means and does not hold it.
    """
    low, high = np.array(bounds, float).T
    best = gp.best if best is None else best

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mean, sd = gp.posterior((pdf[list(parameters)].to_numpy(float) - low) / (high - low))
            yield pdf.assign(mean=mean, sd=sd, acquisition=surrogate.acquisition(name, mean, sd, best, beta))

    schema = T.StructType([*pool.schema.fields, *[T.StructField(c, T.DoubleType()) for c in ("mean", "sd", "acquisition")]])
    return pool.mapInPandas(task, schema)


SAMPLERS.add(ActiveLearningSampler, BayesianOptimizationSampler)
__all__ = ["ActiveLearningSampler", "BayesianOptimizationSampler", "failures", "gathered", "least_distance", "observations", "reduced_target", "score_pool"]
