"""Exact Gaussian processes over all observations given, acquisition functions for one point and for several together, and draws of hyperparameters.

Fits run on the driver; chains, searches and the scoring of pools are dealt over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import space

_SQRT2PI = math.sqrt(2 * math.pi)


def _cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.vectorize(math.erf)(z / math.sqrt(2.0)))


def _pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / _SQRT2PI


KERNELS = ("matern52", "matern32", "matern12", "rbf")


def kernel(name: str, a: np.ndarray, b: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Unit-variance covariance of scaled distances, one length scale per dimension."""
    x, y = a / scales, b / scales
    d2 = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0.0)
    d = np.sqrt(d2)
    if name == "rbf":
        return np.exp(-0.5 * d2)
    if name == "matern12":
        return np.exp(-d)
    if name == "matern32":
        return (1 + math.sqrt(3) * d) * np.exp(-math.sqrt(3) * d)
    if name == "matern52":
        return (1 + math.sqrt(5) * d + 5 * d2 / 3) * np.exp(-math.sqrt(5) * d)
    raise ValueError(f"unknown kernel {name!r}; known: {KERNELS}")


@dataclass
class GaussianProcess:
    """Inputs in the unit cube, outputs standardized; fitted by maximum marginal likelihood."""

    x: np.ndarray
    y: np.ndarray
    mean: float
    scale: float
    kernel_name: str
    scales: np.ndarray
    noise: float
    factor: np.ndarray
    whiten: np.ndarray
    alpha: np.ndarray

    @classmethod
    def with_hyper(cls, x: np.ndarray, y: np.ndarray, name: str, scales: np.ndarray, noise: float) -> GaussianProcess:
        mean, scale = float(y.mean()), float(y.std(ddof=1)) if len(y) > 1 and y.std() > 0 else 1.0
        z = (y - mean) / scale
        k = kernel(name, x, x, scales) + (noise + 1e-8) * np.eye(len(x))
        factor = np.linalg.cholesky(k)
        whiten = np.linalg.inv(factor)  # triangular and small; used for every candidate
        return cls(x, y, mean, scale, name, scales, noise, factor, whiten, whiten.T @ (whiten @ z))

    def log_likelihood(self) -> float:
        z = (self.y - self.mean) / self.scale
        prior = -0.5 * float((np.log(self.scales / 0.5) ** 2).sum()) - 0.1 * (math.log(self.noise) + 7) ** 2
        return float(-0.5 * z @ self.alpha - np.log(np.diag(self.factor)).sum()) + prior

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, name: str = "matern32", *, rounds: int = 60, seed: int = 0) -> GaussianProcess:
        """Random restarts around the best length scales and noise so far, narrowing."""
        rng, dims = np.random.default_rng(seed), x.shape[1]
        best = cls.with_hyper(x, y, name, np.full(dims, 0.5), 1e-3)
        best_ll = best.log_likelihood()
        for k in range(rounds):
            width = 1.5 * (1 - k / rounds) + 0.05
            scales = np.clip(best.scales * np.exp(width * rng.standard_normal(dims)), 0.01, 20.0)
            noise = float(np.clip(best.noise * np.exp(2 * width * rng.standard_normal()), 1e-6, 1.0))
            try:
                tried = cls.with_hyper(x, y, name, scales, noise)
            except np.linalg.LinAlgError:
                continue
            if (ll := tried.log_likelihood()) > best_ll:
                best, best_ll = tried, ll
        return best

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation at ``x``, in the outputs' units."""
        k = kernel(self.kernel_name, x, self.x, self.scales)
        v = self.whiten @ k.T
        return self.mean + self.scale * (k @ self.alpha), self.scale * np.sqrt(np.maximum(1.0 - (v * v).sum(0), 1e-12))

    def joint(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means (r, q) and covariances (r, q, q) of ``r`` sets of ``q`` points."""
        r, q, dims = points.shape
        k = kernel(self.kernel_name, points.reshape(-1, dims), self.x, self.scales)
        v = (self.whiten @ k.T).T.reshape(r, q, -1)
        prior = np.stack([kernel(self.kernel_name, p, p, self.scales) for p in points])
        return (self.mean + self.scale * (k @ self.alpha)).reshape(r, q), self.scale**2 * (prior - v @ v.transpose(0, 2, 1))

    @property
    def best(self) -> float:
        """The greatest output observed."""
        return float(self.y.max())

    def with_point(self, x: np.ndarray, y: float) -> GaussianProcess:
        """The same hyperparameters with one more observation."""
        return GaussianProcess.with_hyper(np.vstack([self.x, x]), np.append(self.y, y), self.kernel_name, self.scales, self.noise)


ACQUISITIONS = ("qLEI", "qUCB", "qEI", "qPI", "EI", "LEI")


def acquisition(name: str, mean: np.ndarray, sd: np.ndarray, best: float, beta: float = 0.2) -> np.ndarray:
    """Value of sampling where the posterior is (mean, sd), for maximization."""
    z = (mean - best) / sd
    if name in ("EI", "qEI"):
        return sd * (z * _cdf(z) + _pdf(z))
    if name in ("LEI", "qLEI"):
        ei = z * _cdf(z) + _pdf(z)
        far = z < -6  # there EI underflows; its asymptote does not
        with np.errstate(divide="ignore"):
            value = np.where(far, -0.5 * z * z - math.log(_SQRT2PI) - 2 * np.log(np.maximum(np.abs(z), 1e-12)), np.log(np.maximum(ei, 1e-300)))
        return value + np.log(sd)
    if name == "qPI":
        return _cdf(z)
    if name == "qUCB":
        return mean + math.sqrt(beta) * sd
    raise ValueError(f"unknown acquisition {name!r}; known: {ACQUISITIONS}")


def propose(gp: GaussianProcess, candidates: np.ndarray, q: int, name: str = "qLEI", beta: float = 0.2) -> np.ndarray:
    """Indexes of ``q`` candidates, greedily: each pick is believed to come out at its mean before the next."""
    picked: list[int] = []
    for _ in range(min(q, len(candidates))):
        mean, sd = gp.posterior(candidates)
        value = acquisition(name, mean, sd, gp.best, beta)
        value[picked] = -np.inf
        k = int(np.argmax(value))
        picked.append(k)
        gp = gp.with_point(candidates[k : k + 1], float(mean[k]))
    return np.array(picked, int)


def refined(gp: GaussianProcess, starts: np.ndarray, name: str, beta: float, step: float = 0.1, least: float = 1e-4) -> np.ndarray:
    """The best point of the unit cube that a compass search finds from any of ``starts``: all of them side by side."""
    value = lambda x: acquisition(name, *gp.posterior(x), gp.best, beta)
    at, found = starts.copy(), value(starts)
    compass = np.concatenate([np.eye(starts.shape[1]), -np.eye(starts.shape[1])])
    for _ in range(200):
        if step < least:
            break
        moves = np.clip(at[:, None] + step * compass[None], 0.0, 1.0)
        tried = value(moves.reshape(-1, starts.shape[1])).reshape(len(at), -1)
        k = tried.argmax(1)
        better = tried[np.arange(len(at)), k] > found
        at[better], found[better] = moves[better, k[better]], tried[better, k[better]]
        step = step if better.any() else step / 2
    return at[int(found.argmax())]


def optimized(gp: GaussianProcess, candidates: np.ndarray, q: int, name: str = "qLEI", beta: float = 0.2, restarts: int = 10) -> np.ndarray:
    """``q`` points, one after the other: the best of searches from the ``restarts`` best candidates, believed to come out at its mean before the next."""
    out = []
    for _ in range(q):
        order = np.argsort(-acquisition(name, *gp.posterior(candidates), gp.best, beta), kind="stable")
        point = refined(gp, candidates[order[:restarts]], name, beta)
        out.append(point)
        gp = gp.with_point(point[None], float(gp.posterior(point[None])[0][0]))
    return np.array(out)


# --- several points at once -----------------------------------------------------


def normal_draws(n: int, q: int, seed: int = 0) -> np.ndarray:
    """``n`` quasi-random draws of ``q`` independent standard normals: Sobol points through the inverse distribution."""
    return np.vectorize(NormalDist().inv_cdf, otypes=[float])(space.sobol_array(n, q, seed))


def joint_acquisition(gp, points: np.ndarray, draws: np.ndarray, name: str = "qLEI", beta: float = 0.2, best: float | None = None) -> np.ndarray:
    """Value of observing the ``q`` points of each of ``points`` (r, q, dims) together, for maximization.

    The draws, of independent normals, are turned into draws of the joint
    posterior by its Cholesky factor; the value is a mean over them of what the
    best of the q outcomes gains.  The logarithmic forms smooth the gain, so
    that it is never quite zero; the probability is smoothed likewise.
    """
    best = gp.best if best is None else best
    mean, covariance = gp.joint(points)
    scale = np.maximum(np.sqrt(np.einsum("rii->ri", covariance).max(axis=1)), 1e-9)[:, None]
    factor = np.linalg.cholesky(covariance + (1e-9 * scale[:, :, None] ** 2 + 1e-15) * np.eye(mean.shape[1]))
    away = np.einsum("rij,sj->rsi", factor, draws)
    if name == "qUCB":
        return (mean[:, None] + math.sqrt(beta * math.pi / 2) * np.abs(away)).max(axis=2).mean(axis=1)
    gain = (mean[:, None] + away).max(axis=2) - best
    if name in ("EI", "qEI"):
        return np.maximum(gain, 0.0).mean(axis=1)
    if name in ("LEI", "qLEI"):
        soft = np.logaddexp(0.0, gain / (1e-3 * scale))
        value = np.log(np.maximum(soft, 1e-300)) + np.log(1e-3 * scale)
        value = np.where(soft > 1e-300, value, gain / (1e-3 * scale) + np.log(1e-3 * scale))
        top = value.max(axis=1, keepdims=True)
        return (top + np.log(np.exp(value - top).mean(axis=1, keepdims=True)))[:, 0]
    if name == "qPI":
        return (0.5 * (1 + np.tanh(gain / (2e-2 * scale)))).mean(axis=1)
    raise ValueError(f"unknown acquisition {name!r}; known: {ACQUISITIONS}")


def joint_search(gp, starts: np.ndarray, draws: np.ndarray, name: str, beta: float, *, step: float = 0.1, least: float = 1e-3, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Better sets of points from ``starts`` (r, q, dims), side by side: one point at a time along the axes, steps halved where no point gains."""
    at, found = starts.copy(), joint_acquisition(gp, starts, draws, name, beta)
    r, q, dims = at.shape
    compass = np.concatenate([np.eye(dims), -np.eye(dims)])
    for _ in range(sweeps):
        if step < least:
            break
        moved = False
        for j in range(q):
            tried = np.repeat(at[:, None], 2 * dims, axis=1)
            tried[:, :, j] = np.clip(tried[:, :, j] + step * compass, 0.0, 1.0)
            value = joint_acquisition(gp, tried.reshape(-1, q, dims), draws, name, beta).reshape(r, -1)
            k = value.argmax(axis=1)
            better = value[np.arange(r), k] > found + 1e-12 * np.abs(found)
            at[better], found[better] = tried[better, k[better]], value[better, k[better]]
            moved |= bool(better.any())
        step = step if moved else step / 2
    return at, found


def joint_optimized(spark, gp, candidates: np.ndarray, q: int, name: str = "qLEI", beta: float = 0.2, *, restarts: int = 10, raw: int = 1024, n_draws: int = 128, seed: int = 0) -> np.ndarray:
    """The best ``q`` points for joint acquisition that searches from many starts find; each start is a row, dealt over tasks.

    ``raw`` sets of q of the candidates are valued, in tasks; the ``restarts``
    best of them, and the greedy choice, are searched from, a task each.  The
    greedy choice is among the starts, so the result is never worth less.
    """
    dims, draws = candidates.shape[1], normal_draws(n_draws, q, seed)
    rng = np.random.default_rng([seed, 7])
    chosen = np.stack([rng.choice(len(candidates), q, replace=len(candidates) < q) for _ in range(raw)])
    shared = spark.sparkContext.broadcast((gp, candidates, draws))

    def value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, points, base = shared.value
        for pdf in batches:
            sets = points[np.stack(pdf["members"].to_numpy())]
            yield pdf.assign(value=np.concatenate([joint_acquisition(model, part, base, name, beta) for part in np.array_split(sets, max(1, len(sets) * q * q // 4096))]))

    rows = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate(chosen)], "number int, members array<int>").repartition(min(raw, spark.sparkContext.defaultParallelism))
    first = rows.mapInPandas(value, "number int, members array<int>, value double").orderBy(F.desc("value"), "number").limit(restarts).collect()
    starts = [candidates[r["members"]] for r in first] + [optimized(gp, candidates, q, name if name != "qPI" else "qEI", beta, restarts)]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, _, base = shared.value
        for pdf in batches:
            at, found = joint_search(model, np.stack(pdf["points"].to_numpy()).reshape(-1, q, dims), base, name, beta)
            yield pd.DataFrame({"number": pdf["number"], "points": list(at.reshape(len(at), -1)), "value": found})

    rows = spark.createDataFrame([(k, s.ravel().tolist()) for k, s in enumerate(starts)], "number int, points array<double>").repartition(len(starts), "number")
    best = rows.mapInPandas(search, "number int, points array<double>, value double").orderBy(F.desc("value"), "number").first()
    return np.array(best["points"]).reshape(q, dims)


# --- hyperparameters drawn from their posterior --------------------------------------


def kernel_slope(name: str, d2: np.ndarray) -> np.ndarray:
    """The derivative of the kernel by the squared scaled distance."""
    d = np.sqrt(d2)
    if name == "rbf":
        return -0.5 * np.exp(-0.5 * d2)
    if name == "matern12":
        return -np.exp(-d) / (2 * np.maximum(d, 1e-12))
    if name == "matern32":
        return -1.5 * np.exp(-math.sqrt(3) * d)
    if name == "matern52":
        return -(5 / 6) * (1 + math.sqrt(5) * d) * np.exp(-math.sqrt(5) * d)
    raise ValueError(f"unknown kernel {name!r}; known: {KERNELS}")


@dataclass(frozen=True)
class HyperPosterior:
    """Log density, and its slope, of theta = the logarithms of length scales and, unless ``noise`` fixes it, of the noise.

    Length scales are lognormal around ``centre`` with the standard deviation
    ``spread`` of the logarithm, the noise lognormal around exp(-7) with 2.2.
    """

    x: np.ndarray
    y: np.ndarray
    kernel_name: str = "matern32"
    noise: float | None = None
    centre: float = 0.5
    spread: float = 1.0

    @property
    def size(self) -> int:
        return self.x.shape[1] + (self.noise is None)

    def start(self) -> np.ndarray:
        return np.append(np.full(self.x.shape[1], math.log(self.centre)), [-7.0] * (self.noise is None))

    def __call__(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        dims = self.x.shape[1]
        if not np.abs(theta).max() < 15.0:  # beyond all that the prior allows for: a step that went astray
            return -math.inf, np.zeros(len(theta))
        scales, noise = np.exp(theta[:dims]), self.noise if self.noise is not None else math.exp(theta[dims])
        try:
            gp = GaussianProcess.with_hyper(self.x, self.y, self.kernel_name, scales, noise)
        except np.linalg.LinAlgError:
            return -math.inf, np.zeros(len(theta))
        z = (self.y - gp.mean) / gp.scale
        log_density = -0.5 * z @ gp.alpha - np.log(np.diag(gp.factor)).sum()
        outer = np.outer(gp.alpha, gp.alpha) - gp.whiten.T @ gp.whiten
        gaps = [((self.x[:, k][:, None] - self.x[:, k][None]) / scales[k]) ** 2 for k in range(dims)]
        weighed = outer * kernel_slope(self.kernel_name, sum(gaps))
        slope = [-float((weighed * g).sum()) for g in gaps]  # one half of the trace, times -2 g for the logarithm of a scale
        if self.noise is None:
            slope.append(0.5 * noise * float(np.trace(outer)))
        middle, width = self.start(), np.append(np.full(dims, self.spread), [2.2] * (self.noise is None))
        away = (theta - middle) / width
        return float(log_density - 0.5 * away @ away), np.array(slope) - away / width


def hamiltonian_chain(density, start: np.ndarray, n: int, warmup: int, seed, leaps: int = 20, accept: float = 0.8) -> np.ndarray:
    """``n`` draws by Hamiltonian Monte Carlo; during ``warmup`` the step is tuned by dual averaging to the wanted acceptance."""
    rng = np.random.default_rng(seed)
    at = start + 0.3 * rng.standard_normal(len(start))
    value, slope = density(at)
    step, centre, drift, averaged = 0.1, math.log(1.0), 0.0, 0.0
    out = np.empty((n, len(start) + 1))
    for k in range(-warmup, n):
        push = rng.standard_normal(len(start))
        energy = value - 0.5 * push @ push
        point, new, turn = at.copy(), value, slope
        push = push + 0.5 * step * turn
        count = int(rng.integers(1, leaps + 1))
        for leap in range(count):
            point = point + step * push
            new, turn = density(point)
            if not math.isfinite(new):
                break
            push = push + (1.0 if leap < count - 1 else 0.5) * step * turn
        chance = math.exp(min(0.0, new - 0.5 * push @ push - energy)) if math.isfinite(new) else 0.0
        if rng.random() < chance:
            at, value, slope = point, new, turn
        if k < 0:
            t = k + warmup + 1
            drift += (accept - chance - drift) / (t + 10)
            log_step = centre - math.sqrt(t) / 0.05 * drift
            averaged += (log_step - averaged) * t**-0.75
            step = math.exp(log_step if k < -1 else averaged)
        else:
            out[k] = [*at, value]
    return out


def hyper_chains(spark, density: HyperPosterior, *, chains: int = 4, draws: int = 400, warmup: int = 200, seed: int = 0) -> DataFrame:
    """chain, draw, theta, log_density: ``chains`` runs of ``hamiltonian_chain``, a task each."""
    shared = spark.sparkContext.broadcast(density)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for chain in pdf["id"]:
                found = hamiltonian_chain(shared.value, shared.value.start(), draws, warmup, [seed, int(chain)])
                yield pd.DataFrame({"chain": int(chain), "draw": np.arange(draws), "theta": list(found[:, :-1]), "log_density": found[:, -1]})

    return spark.range(0, chains, 1, chains).mapInPandas(run, "chain long, draw long, theta array<double>, log_density double")


def split_r_hat(draws: DataFrame) -> DataFrame:
    """parameter, mean, sd, r_hat: over the halves of all chains, by how much the spread between them exceeds that within."""
    halves = draws.withColumn("n", F.max("draw").over(Window.partitionBy("chain")) + 1)
    flat = halves.select("chain", (F.col("draw") * 2 >= F.col("n")).alias("late"), F.posexplode("theta").alias("parameter", "value"))
    each = flat.groupBy("parameter", "chain", "late").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    both = each.groupBy("parameter").agg(F.avg("m").alias("mean"), F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.avg("n").alias("n"))
    total = (F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")
    return both.select("parameter", "mean", F.sqrt(total).alias("sd"), F.sqrt(total / F.col("within")).alias("r_hat"))


@dataclass
class Mixture:
    """Processes of equal weight, for hyperparameters drawn from their posterior; acts as one process."""

    members: list[GaussianProcess]

    @classmethod
    def of_draws(cls, density: HyperPosterior, thetas: np.ndarray) -> Mixture:
        dims = density.x.shape[1]
        noise = lambda t: density.noise if density.noise is not None else math.exp(t[dims])
        return cls([GaussianProcess.with_hyper(density.x, density.y, density.kernel_name, np.exp(t[:dims]), noise(t)) for t in thetas])

    @property
    def best(self) -> float:
        return self.members[0].best

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [m.posterior(x) for m in self.members]
        means, sds = (np.array([f[k] for f in found]) for k in (0, 1))
        mean = means.mean(axis=0)
        return mean, np.sqrt((sds**2 + (means - mean) ** 2).mean(axis=0))

    def joint(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [m.joint(points) for m in self.members]
        means = np.array([f[0] for f in found])
        away = means - means.mean(axis=0)
        return means.mean(axis=0), np.mean([f[1] for f in found], axis=0) + np.einsum("mri,mrj->rij", away, away) / len(found)

    def with_point(self, x: np.ndarray, y: float) -> Mixture:
        return Mixture([m.with_point(x, y) for m in self.members])


def blocks(points: np.ndarray, known: np.ndarray, numbers: int = 4_000_000) -> Iterator[np.ndarray]:
    """``points`` in order, as blocks whose differences to all of ``known`` hold about ``numbers`` numbers."""
    step = max(1, numbers // max(1, known.size))
    for k in range(0, len(points), step):
        yield points[k : k + step]


@dataclass
class KernelRegression:
    """Bagged kernel-weighted means: ``members`` bootstrap samples of the observations."""

    members: list[tuple[np.ndarray, np.ndarray]]
    gamma: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, members: int = 5, gamma: float | None = None, seed: int = 0) -> KernelRegression:
        rng = np.random.default_rng(seed)
        draws = [rng.integers(0, len(x), len(x)) for _ in range(members)]
        return cls([(x[d], y[d]) for d in draws], gamma or 1.0 / max(1e-12, x.shape[1] * float(x.var()) or 1.0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self._predict(part) for part in blocks(x, self.members[0][0])]])

    def _predict(self, x: np.ndarray) -> np.ndarray:
        out = []
        for a, b in self.members:
            d2 = ((x[:, None] - a[None]) ** 2).sum(-1)
            w = np.exp(-self.gamma * (d2 - d2.min(1, keepdims=True)))
            out.append((w * b).sum(1) / w.sum(1))
        return np.mean(out, axis=0)
