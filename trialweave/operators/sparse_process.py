"""A Gaussian process over any number of observations, through inducing points.

With inputs Z of m inducing points, all that the observations (x, y) have to say
is in sums over them: K_mn K_nm, K_mn y, K_mn 1, and the count, sum and sum of
squares of y.  One pass over the table adds them up for several settings of the
kernel's length scales; what follows is linear algebra of m x m matrices on the
driver.  No observation is collected.

The posterior is that of the variational bound, whose mean is the dense closed
form with the covariance K_nm K_mm^-1 K_mn + noise; the bound itself chooses
length scales and noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import space
from .sums import matrix_sums
from .surrogate import kernel

JITTER = 1e-8


@dataclass(frozen=True)
class Sums:
    """What a table of observations adds up to for one setting of the length scales."""

    gram: np.ndarray  # K_mn K_nm
    cross: np.ndarray  # K_mn y
    column: np.ndarray  # K_mn 1
    n: float
    total: float
    square: float
    best: float  # the greatest y

    def with_row(self, k: np.ndarray, y: float) -> Sums:
        return Sums(self.gram + np.outer(k, k), self.cross + k * y, self.column + k, self.n + 1, self.total + y, self.square + y * y, max(self.best, y))


def gram_sums(rows: DataFrame, parameters: Sequence[str], output: str, bounds: Sequence[Sequence[float]], inducing: np.ndarray, kernel_name: str, scales: Sequence[np.ndarray], **how: int) -> list[Sums]:
    """One ``Sums`` for each of ``scales``, from one pass over ``rows``; rows with a null or non-finite value do not count."""
    low, high = np.array(bounds, float).T
    m = len(inducing)
    finite = [F.col(f"`{c}`").cast("double").alias(c) for c in [*parameters, output]]
    numbers = rows.select(*finite)
    for c in numbers.columns:
        numbers = numbers.where(F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`") & (F.abs(f"`{c}`") != float("inf")))

    def of(block: np.ndarray) -> list[np.ndarray]:
        x, y = (block[:, :-1] - low) / (high - low), block[:, -1]
        parts = [np.array([len(y), y.sum(), y @ y])]
        for s in scales:
            k = kernel(kernel_name, inducing, x, s)
            parts += [k @ k.T, k @ y, k.sum(axis=1)]
        return parts

    found = matrix_sums(numbers, of, [(3,), *[(m, m), (m,), (m,)] * len(scales)], **how)
    best = numbers.agg(F.max(f"`{output}`")).first()[0]
    n, total, square = found[0]
    return [Sums(*found[1 + 3 * k : 4 + 3 * k], n, total, square, -math.inf if best is None else best) for k in range(len(scales))]


@dataclass(frozen=True)
class SparseProcess:
    """The posterior given by ``sums``; inputs in the unit cube, outputs standardized, like ``GaussianProcess``."""

    inducing: np.ndarray
    kernel_name: str
    scales: np.ndarray
    noise: float
    sums: Sums

    def __post_init__(self):
        s, m = self.sums, len(self.inducing)
        mean = s.total / s.n if s.n else 0.0
        spread = (s.square - s.n * mean * mean) / (s.n - 1) if s.n > 1 else 0.0
        scale = math.sqrt(spread) if spread > 0 else 1.0
        root = np.linalg.cholesky(kernel(self.kernel_name, self.inducing, self.inducing, self.scales) + JITTER * np.eye(m))
        whiten = np.linalg.inv(root)
        gram = whiten @ s.gram @ whiten.T
        factor = np.linalg.cholesky(np.eye(m) + gram / self.noise)
        inner = np.linalg.inv(factor) @ whiten
        weight = inner @ ((s.cross - mean * s.column) / scale) / self.noise
        made = {"mean": mean, "scale": scale, "whiten": whiten, "inner": inner, "alpha": inner.T @ weight, "weight": weight, "factor": factor, "explained": float(np.trace(gram))}
        for name, value in made.items():
            object.__setattr__(self, name, value)

    @property
    def best(self) -> float:
        return self.sums.best

    def bound(self) -> float:
        """The variational lower bound of the log marginal likelihood."""
        s, v = self.sums, self.noise
        square = (s.square - s.n * self.mean**2) / self.scale**2
        fit = -0.5 * s.n * math.log(2 * math.pi * v) - np.log(np.diag(self.factor)).sum() - 0.5 * square / v + 0.5 * self.weight @ self.weight
        return float(fit - 0.5 * max(0.0, s.n - self.explained) / v)

    def _cross(self, x: np.ndarray) -> np.ndarray:
        return kernel(self.kernel_name, self.inducing, x, self.scales)

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation at ``x``, in the outputs' units."""
        k = self._cross(x)
        before, after = self.whiten @ k, self.inner @ k
        variance = 1.0 - (before * before).sum(0) + (after * after).sum(0)
        return self.mean + self.scale * (k.T @ self.alpha), self.scale * np.sqrt(np.maximum(variance, 1e-12))

    def joint(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means (r, q) and covariances (r, q, q) of ``r`` sets of ``q`` points."""
        r, q, dims = points.shape
        k = self._cross(points.reshape(-1, dims))
        means = (self.mean + self.scale * (k.T @ self.alpha)).reshape(r, q)
        before, after = ((a @ k).T.reshape(r, q, -1) for a in (self.whiten, self.inner))
        prior = np.stack([kernel(self.kernel_name, p, p, self.scales) for p in points])
        return means, self.scale**2 * (prior - before @ before.transpose(0, 2, 1) + after @ after.transpose(0, 2, 1))

    def with_point(self, x: np.ndarray, y: float) -> SparseProcess:
        return replace(self, sums=self.sums.with_row(self._cross(x)[:, 0], float(y)))


def inducing_grid(dims: int, n: int, seed: int = 0) -> np.ndarray:
    """``n`` scrambled Sobol points of the unit cube."""
    return space.sobol_array(n, dims, seed)


def fit(rows: DataFrame, parameters: Sequence[str], output: str, bounds: Sequence[Sequence[float]], *, kernel_name: str = "matern32", inducing: np.ndarray | int = 64, rounds: int = 3, tries: int = 8, seed: int = 0) -> SparseProcess | None:
    """The process of the best bound among length scales around the best so far, ``tries`` of them a pass, and noises; None without rows."""
    dims, rng = len(parameters), np.random.default_rng(seed)
    z = inducing_grid(dims, inducing, seed) if isinstance(inducing, int) else inducing
    best: SparseProcess | None = None
    centre = np.full(dims, 0.5)
    for k in range(rounds):
        width = 1.2 * (1 - k / rounds) + 0.1
        scales = [centre, *[np.clip(centre * np.exp(width * rng.standard_normal(dims)), 0.02, 20.0) for _ in range(tries - 1)]]
        for s, sums in zip(scales, gram_sums(rows, parameters, output, bounds, z, kernel_name, scales), strict=True):
            if not sums.n:
                return None
            for noise in 10.0 ** np.arange(-6, 0.51, 0.5):
                tried = SparseProcess(z, kernel_name, s, float(noise), sums)
                if best is None or tried.bound() > best.bound():
                    best = tried
        centre = best.scales
    return best


def variance_reduction(pool: DataFrame, process: SparseProcess, parameters: Sequence[str], bounds: Sequence[Sequence[float]], column: str = "reduction") -> DataFrame:
    """``pool`` with ``column``: by how much observing a row would lower the mean posterior variance of all rows of ``pool``.

    Observing c lowers the variance at x by cov(x, c)^2 / (var(c) + noise).  The
    covariance that the inducing points carry is k(x)' S k(c), so the mean over
    all x is k(c)' S (mean of k(x) k(x)') S k(c): a sum of m x m matrices over
    the pool, and then one number a row.  Rows with a null parameter have none.
    """
    low, high = np.array(bounds, float).T
    names = [f"`{p}`" for p in parameters]
    numbers = pool.select(*[F.col(p).cast("double") for p in names]).dropna()
    unit = lambda block: (block - low) / (high - low)
    m = len(process.inducing)

    def of(block: np.ndarray) -> list[np.ndarray]:
        k = process._cross(unit(block))
        return [k @ k.T, np.array([float(len(block))])]

    gram, (n,) = matrix_sums(numbers, of, [(m, m), (1,)])
    carried = process.inner.T @ process.inner  # S
    middle = carried @ (gram / max(1.0, n)) @ carried
    schema = T.StructType([*pool.schema.fields, T.StructField(column, T.DoubleType())])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[list(parameters)].to_numpy(float, na_value=np.nan)
            whole = ~np.isnan(x).any(axis=1)
            value = np.full(len(x), np.nan)
            if whole.any():
                k = process._cross(unit(x[whole]))
                sd = process.posterior(unit(x[whole]))[1]
                value[whole] = process.scale**2 * ((middle @ k) * k).sum(0) / ((sd / process.scale) ** 2 + process.noise)
            yield pdf.assign(**{column: value})

    return pool.mapInPandas(task, schema).withColumn(column, F.nanvl(column, F.lit(None).cast("double")))
