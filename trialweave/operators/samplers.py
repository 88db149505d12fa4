"""Samplers: generator DataFrames of parameter points.

A sampler is a pure function of its configuration and an index range, so a
batch can be made again anywhere, and skipping batches is free.  Points are
expressions over ``spark.range``: nothing is collected and nothing shuffled.
"""

from __future__ import annotations

import importlib
import itertools
import logging
import math
import operator
import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import random as rnd
from ..functions import space

log = logging.getLogger(__name__)
MAX_POINTS = 100_000


class Sampler:
    """Common part: a budget served in batches of ``batch_size``."""

    def __init__(self, bounds: Sequence = (), parameters: Sequence[str] = (), budget: int | None = 100, batch_size: int | None = None, seed: int = 0):
        if len(bounds) != len(parameters):
            raise ValueError("bounds and parameters differ in length")
        self.bounds, self.parameters, self.seed = [list(b) for b in bounds], list(parameters), int(seed)
        self.budget = 100 if budget is None else int(budget)
        self.batch_size = int(batch_size or self.budget)

    adaptive = False
    #: Whether a last batch is cut to the budget; otherwise a batch is always full.
    truncates = True

    @property
    def n_batches(self) -> int:
        return math.ceil(self.budget / self.batch_size) if self.budget > 0 else 0

    def batch_range(self, number: int, submitted: int | None = None) -> tuple[int, int]:
        """(first index, points) of batch ``number``; no points once the budget is spent.

        ``submitted`` is how many points the batches before it had: all of them
        full, unless it is given.  It differs where a last batch was cut to a
        budget that has been extended since.
        """
        start = number * self.batch_size if submitted is None else submitted
        if start >= self.budget:
            return start, 0
        return start, min(self.batch_size, self.budget - start) if self.truncates else self.batch_size

    def batch(self, spark: SparkSession, number: int, submitted: int | None = None) -> DataFrame | None:
        """sample (from 0 within the batch) and the parameters; None once the budget is spent."""
        start, n = self.batch_range(number, submitted)
        if n <= 0:
            return None
        return self.frame(spark, start, n).withColumn("sample", F.col("sample") - start)

    def frame(self, spark: SparkSession, start: int, n: int) -> DataFrame:
        """sample (the global index) and the parameters of points start .. start + n - 1."""
        index = F.col("id")
        return spark.range(start, start + n).select(index.alias("sample"), *[self.value(k, index).alias(p) for k, p in enumerate(self.parameters)])

    def value(self, k: int, index: Column) -> Column:
        raise NotImplementedError

    def extended(self, more: int) -> Sampler:
        """The same sampler with a larger budget."""
        self.budget += more
        return self


def _sizes_checked(sizes: list[int], what: str, max_points: int) -> int:
    n = math.prod(sizes)
    if n > max_points:
        raise ValueError(f"{what} of {n} points is above the limit of {max_points}")
    return n


class _Product(Sampler):
    """A finite set of points: nothing is left to extend it by."""

    def extended(self, more: int) -> Sampler:
        if more:
            log.warning("%s has no more than its %s points; it is not extended", type(self).__name__, self.budget)
        return self


class ArraySampler(_Product):
    """All combinations of literal lists, the last parameter fastest; the budget is their number."""

    def __init__(self, bounds: Sequence[Sequence[Any]], parameters: Sequence[str], batch_size: int | None = None, max_points: int = MAX_POINTS, **_: Any):
        self.sizes = [len(b) for b in bounds]
        super().__init__(bounds, parameters, _sizes_checked(self.sizes, "array sampling", max_points), batch_size)

    def value(self, k: int, index: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in self.bounds[k]]), space.digit(index, self.sizes, k).cast("int"))


class GridSampler(_Product):
    """Evenly spaced points per parameter, both ends included, and all their combinations."""

    def __init__(self, bounds: Sequence[Sequence[float]], num_samples: int | Sequence[int], parameters: Sequence[str], batch_size: int | None = None, max_points: int = MAX_POINTS, **_: Any):
        self.sizes = [int(num_samples)] * len(bounds) if isinstance(num_samples, int) else [int(n) for n in num_samples]
        if len(self.sizes) != len(bounds):
            raise ValueError("num_samples and bounds differ in length")
        super().__init__(bounds, parameters, _sizes_checked(self.sizes, "grid search", max_points), batch_size)

    def value(self, k: int, index: Column) -> Column:
        return space.linspace(space.digit(index, self.sizes, k), *self.bounds[k], self.sizes[k])


class RandomSampler(Sampler):
    """Independent draws; every batch is full, past the budget too."""

    truncates = False
    DISTRIBUTIONS = ("uniform", "loguniform", "normal", "int_uniform")

    def __init__(self, bounds: Sequence[Sequence[float]], budget: int, parameters: Sequence[str], batch_size: int | None = None, distribution: str = "uniform", seed: int = 0, **_: Any):
        super().__init__(bounds, parameters, budget, batch_size, seed)
        if distribution not in self.DISTRIBUTIONS:
            raise ValueError(f"unknown distribution {distribution!r}")
        self.distribution = distribution

    def value(self, k: int, index: Column) -> Column:
        low, high = self.bounds[k]
        u = rnd.unit(self.seed, self.parameters[k], index)
        if self.distribution == "normal":
            return rnd.normal(u, rnd.unit(self.seed, self.parameters[k] + "'", index), low, high)
        return {"uniform": rnd.uniform, "loguniform": rnd.loguniform, "int_uniform": rnd.int_uniform}[self.distribution](u, low, high)


class SamplerKilled(RuntimeError):
    """Raised by a sampler that is told to stop."""


class RandomSamplerWithKill(RandomSampler):
    """A uniform sampler that raises after ``kill_after`` batches: for tests of resuming."""

    def __init__(self, bounds, budget, parameters, batch_size=None, kill_after: int | None = None, seed: int = 0, **_: Any):
        super().__init__(bounds, budget, parameters, batch_size, seed=seed)
        self.kill_after = kill_after

    def batch(self, spark: SparkSession, number: int, submitted: int | None = None) -> DataFrame | None:
        if self.kill_after and number >= self.kill_after:
            raise SamplerKilled(f"killed after {self.kill_after} batches")
        return super().batch(spark, number, submitted)


class LatinHypercubeSampler(Sampler):
    """Each batch has one point in each of its n strata of every dimension; the last batch is cut to the budget.

    Strata are dealt by a permutation that is evaluated row by row, of any
    number of points: nothing is ranked, and a batch is the same whether it is
    made alone or with others.
    """

    def __init__(self, bounds, budget, parameters, batch_size=None, seed: int = 0, **_: Any):
        super().__init__(bounds, parameters, budget, batch_size, seed)

    def frame(self, spark: SparkSession, start: int, n: int) -> DataFrame:
        """Points of the batches from ``start`` on; ``start`` must be a batch's first index."""
        if start % self.batch_size:
            raise ValueError("a latin hypercube is made by whole batches")
        size = F.lit(self.batch_size).cast("long")
        rows = spark.range(start, start + n).select(F.col("id").alias("sample"), F.floor(F.col("id") / size).cast("long").alias("_batch"), (F.col("id") % size).alias("_place"))
        return self._cubes(rows.withColumn("_n", F.least(size, F.lit(start + n) - F.col("_batch") * size)))

    def batch(self, spark: SparkSession, number: int, submitted: int | None = None) -> DataFrame | None:
        """One hypercube of min(batch_size, what is left of the budget) points, whatever sizes the batches before it had."""
        start, n = self.batch_range(number, submitted)
        if n <= 0:
            return None
        rows = spark.range(start, start + n).select(F.col("id").alias("sample"), F.lit(number).cast("long").alias("_batch"), (F.col("id") - start).alias("_place"), F.lit(n).cast("long").alias("_n"))
        return self._cubes(rows).withColumn("sample", F.col("sample") - start)

    def _cubes(self, rows: DataFrame) -> DataFrame:
        """Points of ``rows`` (sample, and the number, place and size of its hypercube)."""
        values = []
        for p, bounds in zip(self.parameters, self.bounds, strict=True):
            stratum = rnd.permuted(F.col("_place"), F.col("_n"), self.seed, p, F.col("_batch"))
            values.append(rnd.uniform((stratum + rnd.unit(self.seed, p, F.col("sample"))) / F.col("_n"), *bounds).alias(p))
        return rows.select("sample", *values)


class SobolSequenceSampler(Sampler):
    """Sobol points, the budget rounded down to a power of two.

    ``scramble`` is "owen" (or true), a nested uniform permutation of the
    digits by hashed prefixes, "shift", a digital shift, or false.  Both are
    seeded and keep every net a net.  The sequence goes on where a smaller
    budget ended: a design of 2 ** m points is the start of one of 2 ** (m + 1).
    """

    def __init__(self, bounds, budget, parameters, batch_size=None, scramble: bool | str = True, seed: int = 42, **_: Any):
        self.log2 = self._log2(budget)
        super().__init__(bounds, parameters, 1 << self.log2, min(batch_size or budget, 1 << self.log2), seed)
        self.scramble = {True: "owen", False: None}.get(scramble, scramble)
        if self.scramble not in ("owen", "shift", None):
            raise ValueError(f"unknown scrambling {scramble!r}; known: owen, shift")

    @staticmethod
    def _log2(budget: int) -> int:
        log2 = max(0, int(budget).bit_length() - 1)
        if budget != 1 << log2:
            log.warning("a Sobol budget of %s is rounded down to %s", budget, 1 << log2)
        return log2

    def key(self, k: int) -> int:
        return random.Random(f"{self.seed}:{k}").getrandbits(space.SOBOL_BITS)

    def frame(self, spark: SparkSession, start: int, n: int) -> DataFrame:
        if self.scramble != "owen":
            return super().frame(spark, start, n)
        points = {f"_u{k}": (k, self.key(k)) for k in range(len(self.parameters))}
        rows = space.with_owen_sobol(spark.range(start, start + n), F.col("id"), points, self.log2)
        return rows.select(F.col("id").alias("sample"), *[space.unnormalize(F.col(u), *self.bounds[k]).alias(p) for k, (u, p) in enumerate(zip(points, self.parameters, strict=True))])

    def value(self, k: int, index: Column) -> Column:
        shift, owen = (self.key(k) if self.scramble == kind else None for kind in ("shift", "owen"))
        return space.unnormalize(space.sobol(index, k, self.log2, shift or 0, owen), *self.bounds[k])

    def extended(self, more: int) -> Sampler:
        """The next points of the sequence, up to the power of two at or below budget + ``more``."""
        if more:
            self.log2 = self._log2(self.budget + more)
            self.budget = 1 << self.log2
        return self


class NestedSampler(Sampler):
    """The product of other samplers' first batches, the last fastest; of equal parameter names the later sampler's counts."""

    def __init__(self, samplers: dict[str, Sampler], budget: int | None = None, batch_size: int | None = None, max_broadcast: int = 1_000_000, **_: Any):
        self.samplers = samplers
        self.sizes = [s.batch_range(0)[1] for s in samplers.values()]
        names = list(dict.fromkeys(p for s in samplers.values() for p in s.parameters))
        n = math.prod(self.sizes)
        super().__init__([()] * len(names), names, n if budget is None else min(budget, n), n)
        self.max_broadcast = max_broadcast

    @property
    def runs_by_depth(self) -> list[int]:
        """Runs at each depth if the samplers were levels: the running product of their batches."""
        return list(itertools.accumulate(self.sizes, operator.mul))

    @property
    def total_runs(self) -> int:
        return sum(self.runs_by_depth)

    def extended(self, more: int) -> Sampler:
        if more:
            log.warning("a nested sampler has the product of its samplers' first batches; it is not extended")
        return self

    def batch(self, spark: SparkSession, number: int, submitted: int | None = None) -> DataFrame | None:
        if number:
            if submitted is not None and submitted >= self.budget:
                return None
            raise NotImplementedError("a nested sampler has one batch")
        out = None
        for n, s in zip(self.sizes, self.samplers.values(), strict=True):
            points = s.batch(spark, 0)
            points = points.select(F.col("sample").alias("_s"), *s.parameters)
            if out is None:
                out = points.withColumnRenamed("_s", "sample")
                continue
            out = out.drop(*[p for p in s.parameters if p in out.columns])
            out = out.crossJoin(F.broadcast(points) if n <= self.max_broadcast else points).withColumn("sample", F.col("sample") * n + F.col("_s")).drop("_s")
        return out.where(F.col("sample") < self.budget).select("sample", *self.parameters)


@dataclass
class Registry:
    """Names to classes: built-ins first come from decorators, others from entry points of ``group``."""

    group: str
    known: dict[str, type] = field(default_factory=dict)

    @staticmethod
    def key(name: str) -> str:
        return name.replace("_", "").lower()

    def add(self, *classes: type) -> None:
        self.known |= {self.key(c.__name__): c for c in classes}

    def reset(self, *names: str) -> None:
        for n in names:
            self.known.pop(self.key(n), None)

    def find(self, name: str) -> type:
        """The class of a snake_case or PascalCase name; a plug-in of that name comes before a built-in.

        "package.module:Class" is imported as it stands.
        """
        from importlib.metadata import entry_points

        if ":" in name:
            module, _, attribute = name.partition(":")
            return getattr(importlib.import_module(module), attribute)

        for point in entry_points(group=self.group):
            if self.key(point.name) == self.key(name):
                try:
                    return point.load()
                except Exception:
                    log.exception("the plug-in %s of %s does not load", point.name, self.group)
        if self.key(name) not in self.known:
            raise ValueError(f"{name!r} names nothing in {self.group}; known: {sorted(self.known)}")
        return self.known[self.key(name)]


SAMPLERS = Registry("trialweave.samplers")
SAMPLERS.add(ArraySampler, GridSampler, RandomSampler, RandomSamplerWithKill, LatinHypercubeSampler, SobolSequenceSampler, NestedSampler)


def make_sampler(config: dict[str, Any]) -> Sampler:
    """A sampler from its configuration: ``type`` and its arguments; a nested one has its own under ``samplers``."""
    config = dict(config)
    cls = SAMPLERS.find(config.pop("type"))
    if cls is NestedSampler:
        config["samplers"] = {name: make_sampler(c) for name, c in config["samplers"].items()}
    return cls(**config)
