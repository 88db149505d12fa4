"""Kernel-weighted statistics of observations around candidates, and what follows from them.

Around a candidate, an observation weighs k(candidate, observation), a Gaussian
kernel.  The weighted count, sum and sum of squares are all that a conjugate
normal-inverse-chi-squared update needs, and they add up: observations at equal
inputs are summed first, candidates and observations are dealt into blocks, and
each pair of blocks gives its part of the sums.  Neither side is collected, and
no pair of rows ever is a row.

Committees are the same sums with other weights: in each member an observation
counts as often as a Poisson draw from a hash of its row says, which is a
bootstrap sample without a pass that resamples.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import random as rnd


def poisson_one(u: Column, most: int = 8) -> Column:
    """How often an observation counts: a Poisson draw of mean 1 from a uniform value, cut at ``most``."""
    reached, chance = F.lit(0.0), math.exp(-1.0)
    total = chance
    for k in range(1, most + 1):
        reached = reached + F.when(u >= total, 1.0).otherwise(0.0)
        chance /= k
        total += chance
    return reached


def kernel_sums(candidates: DataFrame, observations: DataFrame, key: str, parameters: Sequence[str], output: str, gamma: float, *, members: int = 0, row_id: str | None = None, seed: int = 0, candidate_rows: int = 4096, observation_rows: int = 16_384) -> DataFrame:
    """key, and arrays ``n``, ``total``, ``square`` of 1 + ``members`` values, for every candidate that has all ``parameters``.

    Place 0 has all observations, each of the others those of one bootstrap
    member, drawn from the hash of ``row_id`` (a column that tells observations
    apart).  Candidates of one key are one, at the least of their inputs;
    observations with a null do not count; without observations all values
    are 0.  ``gamma`` is that of exp(-gamma * squared distance).
    """
    inputs = [F.col(f"`{p}`").cast("double").alias(f"x{k}") for k, p in enumerate(parameters)]
    names = [f"x{k}" for k in range(len(parameters))]
    y = F.col(f"`{output}`").cast("double").alias("y")
    if members and row_id is None:
        raise ValueError("a committee needs row_id: equal rows would be drawn together")
    seen = observations.select(*inputs, y, *([F.col(row_id).alias("id")] if members else [])).dropna(subset=[*names, "y"])
    weights = [F.lit(1.0), *[poisson_one(rnd.unit(seed, f"member/{b}", F.col("id"))) for b in range(members)]]
    sums = [F.sum(w * v).alias(f"{name}{b}") for b, w in enumerate(weights) for name, v in (("n", F.lit(1.0)), ("t", F.col("y")), ("s", F.col("y") * F.col("y")))]
    seen = seen.groupBy(*names).agg(*sums)  # equal inputs are one row
    asked = candidates.select(F.col(key).alias("key"), *inputs).dropna().groupBy("key").agg(F.min(F.struct(*names)).alias("at")).select("key", "at.*")
    n_asked, n_seen = asked.count(), seen.count()
    across, down = max(1, -(-n_seen // observation_rows)), max(1, -(-n_asked // candidate_rows))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("row", F.pmod(F.xxhash64("key"), F.lit(down)).cast("int")).withColumn("column", spread(across))
    right = seen.withColumn("column", F.pmod(F.xxhash64(*names), F.lit(across)).cast("int")).withColumn("row", spread(down))
    fields = [f"{name}{b}" for b in range(members + 1) for name in "nts"]
    out_schema = asked.select("key").schema
    for f in fields:
        out_schema = out_schema.add(f, "double")

    def cell(some: pa.Table, others: pa.Table) -> pa.Table:
        matrix = lambda t, columns: np.column_stack([t[c].to_numpy() for c in columns]).astype(float) if t.num_rows else np.zeros((0, len(columns)))
        a, b, values = matrix(some, names), matrix(others, names), matrix(others, fields)
        order = np.lexsort(b.T) if len(b) else np.zeros(0, np.int64)  # one order of summation, so that reruns agree
        b, values, out = b[order], values[order], np.zeros((len(a), len(fields)))
        step = max(1, (1 << 21) // max(1, len(b)))
        for start in range(0, len(a), step):
            part = a[start : start + step]
            d2 = sum((part[:, k][:, None] - b[:, k][None]) ** 2 for k in range(len(names)))
            out[start : start + step] = np.exp(-gamma * d2) @ values
        return pa.table({"key": some["key"], **{f: pa.array(out[:, k]) for k, f in enumerate(fields)}})

    found = left.groupBy("row", "column").cogroup(right.groupBy("row", "column")).applyInArrow(cell, out_schema)
    total = found.groupBy("key").agg(*[F.sum(f).alias(f) for f in fields])
    arrays = [F.array(*[F.col(f"{name}{b}") for b in range(members + 1)]).alias(label) for name, label in (("n", "n"), ("t", "total"), ("s", "square"))]
    return total.select(F.col("key").alias(key), *arrays)


@dataclass(frozen=True)
class NormalPrior:
    """A normal-inverse-chi-squared prior: mean and how many observations it is worth, variance and its degrees of freedom."""

    mean: float = 0.0
    mean_weight: float = 0.1
    variance: float = 1.0
    freedom: float = 2.5

    def posterior(self, n: Column, total: Column, square: Column) -> tuple[Column, Column, Column]:
        """(mean, variance of a new observation, degrees of freedom) after observations of these sums."""
        weight = n + self.mean_weight
        mean = (total + self.mean_weight * self.mean) / weight
        freedom = n + self.freedom
        # squares about the mean of both the prior and the observations
        scatter = self.freedom * self.variance + square + self.mean_weight * self.mean**2 - weight * mean * mean
        scale = F.greatest(scatter, F.lit(0.0)) / freedom
        spread = scale * (weight + 1.0) / weight
        return mean, F.when(freedom > 2, spread * freedom / (freedom - 2.0)), freedom


def kernel_regression(candidates: DataFrame, observations: DataFrame, key: str, parameters: Sequence[str], output: str, gamma: float, prior: NormalPrior = NormalPrior(), **how) -> DataFrame:
    """key, mean, sd, weight for every candidate: the predictive distribution (Student's t) of an observation there.

    ``weight`` is the kernel-weighted number of observations.  Where it is small
    the prior speaks; ``sd`` is null where the degrees of freedom are not above 2.
    """
    sums = kernel_sums(candidates, observations, key, parameters, output, gamma, **how)
    n, total, square = (F.get(c, 0) for c in ("n", "total", "square"))
    mean, variance, _ = prior.posterior(n, total, square)
    return sums.select(key, mean.alias("mean"), F.sqrt(variance).alias("sd"), n.alias("weight"))


def committee_scores(candidates: DataFrame, observations: DataFrame, key: str, parameters: Sequence[str], output: str, gamma: float, row_id: str, members: int = 5, prior: NormalPrior = NormalPrior(), **how) -> DataFrame:
    """key, mean, disagreement for every candidate: the committee's mean, and the standard deviation of its members' means."""
    sums = kernel_sums(candidates, observations, key, parameters, output, gamma, members=members, row_id=row_id, **how)
    means = [prior.posterior(F.get("n", b), F.get("total", b), F.get("square", b))[0] for b in range(1, members + 1)]
    mean = sum(means[1:], means[0]) / members
    gaps = [(m - mean) * (m - mean) for m in means]
    return sums.select(key, mean.alias("mean"), F.sqrt(sum(gaps[1:], gaps[0]) / members).alias("disagreement"))
