"""Linear text classifiers on n-gram indicators scaled by naive Bayes log-count ratios.

The ratios compare, over all labelled rows, how many documents of either class
have an n-gram.  On a bounded sample the scaled indicators then train a linear
model: logistic loss for toxicity (L-BFGS), hinge loss for quality (dual
coordinate descent).  A held-back part of the sample turns margins into
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, stored
from .grams import Grams, Sample, document_counts, sample_features, with_text


@dataclass(frozen=True)
class BinaryModel:
    grams: Grams
    weights: np.ndarray  # ratio times weight, by bucket
    bias: float
    slope: float  # probability = sigmoid(slope * margin + offset)
    offset: float
    norms: np.ndarray | None = None  # squared ratios: rows are scaled to unit length

    def scorer(self):
        indicate = self.grams.indicator()

        def of(text: str) -> float:
            at = indicate(text)
            margin = float(self.weights[at].sum())
            if self.norms is not None:
                margin /= float(np.sqrt(self.norms[at].sum())) or 1.0
            return float(sigmoid(self.slope * (margin + self.bias) + self.offset))

        return of


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def log_ratios(positive: tuple[int, np.ndarray], negative: tuple[int, np.ndarray], smoothing: float = 1.0) -> np.ndarray:
    """log of smoothed document rates in the positive over the negative class; zero for n-grams that no document has."""
    (n1, c1), (n0, c0) = positive, negative
    r = np.log((c1 + smoothing) / (n1 + 2 * smoothing)) - np.log((c0 + smoothing) / (n0 + 2 * smoothing))
    return np.where(c1 + c0 > 0, r, 0.0)


class Rows:
    """A sample's scaled rows, for products with weight vectors."""

    def __init__(self, sample: Sample, ratios: np.ndarray, which: np.ndarray, unit: bool):
        self.index = [sample.index[sample.row(k)] for k in which]
        self.index = [i[ratios[i] != 0.0] for i in self.index]
        self.value = [ratios[i].astype(np.float32) for i in self.index]
        if unit:
            self.value = [v / (np.sqrt(v @ v) or 1.0) for v in self.value]
        self.y = np.array([1.0 if sample.labels[k] == "1" else -1.0 for k in which])

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(self.index), dtype=np.int32), [len(i) for i in self.index])
        return row, np.concatenate([np.zeros(0, np.int32), *self.index]), np.concatenate([np.zeros(0, np.float32), *self.value])

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.array([v @ w[i] for i, v in zip(self.index, self.value, strict=True)]) + b


def logistic(rows: Rows, size: int, *, l2: float, steps: int = 60, memory: int = 8) -> tuple[np.ndarray, float]:
    """Class-balanced L2 logistic regression by L-BFGS with backtracking."""
    row, index, value = rows.flat()
    y, n = rows.y, len(rows.y)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    used = np.flatnonzero(np.bincount(index, minlength=size))
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    at = place[index]
    del index
    pieces = [slice(k, k + (1 << 19)) for k in range(0, len(at), 1 << 19)]  # what is made on the way stays small

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z, gradient = np.full(n, w[-1]), l2 * w
        for p in pieces:
            z += np.bincount(row[p], w[at[p]] * value[p], n)
        z *= y
        g = -share * y * sigmoid(-z)
        for p in pieces:
            gradient[:-1] += np.bincount(at[p], g[row[p]] * value[p], len(used))
        gradient[-1] = g.sum()
        return float((share * np.logaddexp(0.0, -z)).sum() + 0.5 * l2 * w[:-1] @ w[:-1]), gradient

    w = np.zeros(len(used) + 1)
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, t in reversed(past):
            a = (s @ d) / (s @ t)
            d = d - a * t
            kept.append((a, s, t))
        if past:
            s, t = past[-1]
            d = d * ((s @ t) / (t @ t))
        for a, s, t in reversed(kept):
            d = d + (a - (t @ d) / (s @ t)) * s
        step, slope = 1.0 if past else min(1.0, 1.0 / (np.abs(g).sum() or 1.0)), g @ d
        while True:
            new = w + step * d
            f_new, g_new = loss(new)
            if f_new <= f + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, t = new - w, g_new - g
        if s @ t > 1e-12:
            past = [*past, (s, t)][-memory:]
        done = abs(f - f_new) <= 1e-7 * max(1.0, abs(f))
        w, f, g = new, f_new, g_new
        if done:
            break
    full = np.zeros(size)
    full[used] = w[:-1]
    return full, float(w[-1])


def dual_coordinate_descent(rows: Rows, size: int, *, c: float, epochs: int = 15, seed: int = 3) -> tuple[np.ndarray, float]:
    """Linear support vector machine with hinge loss: exact steps on one dual variable at a time, classes weighted alike."""
    w, b, n = np.zeros(size), 0.0, len(rows.y)
    alpha, square = np.zeros(n), np.array([v @ v + 1.0 for v in rows.value])
    pos = max(1, int((rows.y > 0).sum()))
    bound = np.where(rows.y > 0, c * n / (2 * pos), c * n / (2 * max(1, n - pos)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for k in rng.permutation(n):
            i, v, y = rows.index[k], rows.value[k], rows.y[k]
            g = y * (v @ w[i] + b) - 1.0
            new = min(max(alpha[k] - g / square[k], 0.0), bound[k])
            if (d := new - alpha[k]) != 0.0:
                w[i] += d * y * v
                b += d * y
                alpha[k] = new
                most = max(most, abs(d) * square[k])
        if most < 1e-3:
            break
    return w, b


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the sigmoid that best maps margins to classes, with smoothed targets; Newton's method."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
    a, b = 1.0, 0.0

    def loss(a: float, b: float) -> float:
        z = a * margins + b
        return float((np.logaddexp(0.0, z) - target * z).sum())

    for _ in range(100):
        p = sigmoid(a * margins + b)
        g, h = np.array([((p - target) * margins).sum(), (p - target).sum()]), p * (1 - p)
        hess = np.array([[(h * margins * margins).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        d, step, now = np.linalg.solve(hess, g), 1.0, loss(a, b)
        while loss(a - step * d[0], b - step * d[1]) > now and step > 1e-6:
            step /= 2
        a, b = a - step * d[0], b - step * d[1]
        if np.abs(d).max() < 1e-6:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def train(labelled: DataFrame, learner: str, *, grams: Grams, max_rows: int = 6000, max_entries: int = 5_000_000, l2: float = 1e-3, c: float = 1.0, unit: bool = False) -> BinaryModel | None:
    """Learn from ``labelled`` (text, label 0 or 1); None unless both classes occur.

    ``learner`` is "logistic" or "hinge".  Log-count ratios cover every row,
    and all of them count, however mild or rare.  Other labels, and null, teach
    nothing; a null text is an empty one; an empty table gives no model.
    Repeated rows count in the ratios as often as they come.
    Sample bound: of either class ``max_rows`` / 2 distinct texts, chosen by
    their hash and each taken once however often it is repeated, and in all
    ``max_entries`` features.
    """
    rows = labelled.where(F.col("label").isin(0, 1)).select(F.col("label").cast("int").cast("string").alias("label"), "text")
    counted = document_counts(rows, grams)
    if set(counted) != {"0", "1"}:
        return None
    ratios = log_ratios(counted["1"], counted["0"])
    sample = sample_features(rows, grams, per_label=max(1, max_rows // 2), max_entries=max_entries, counts=False, useful=ratios != 0.0, salt=2)
    return fit(sample, ratios, learner, grams, l2=l2, c=c, unit=unit)


def fit(sample: Sample, ratios: np.ndarray, learner: str, grams: Grams, *, l2: float, c: float, unit: bool) -> BinaryModel:
    mix = np.random.default_rng(9).permutation(len(sample.labels))
    held = mix[: len(mix) // 5]
    rows, kept = Rows(sample, ratios, mix[len(held) :], unit), Rows(sample, ratios, held, unit)
    w, b = logistic(rows, grams.size, l2=l2) if learner == "logistic" else dual_coordinate_descent(rows, grams.size, c=c)
    slope, offset = platt(kept.margins(w, b), kept.y)
    return BinaryModel(grams, ratios * w, b, slope, offset, ratios**2 if unit else None)


def score(docs: DataFrame, model: BinaryModel | None, threshold: float, *keep) -> DataFrame:
    """``keep`` columns, score and predicted (1 at ``threshold`` or more) for every row of ``docs`` (text); a null text is empty.

    Without a model (one class only) every score is 0.  Kept columns named
    ``score`` or ``predicted`` give way to the new ones; others pass through,
    whatever their names.  Repeated rows are scored each; an empty table gives
    no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, text = with_text(docs, F.coalesce("text", F.lit("")), keep, ("score", "predicted"))
    n = len(rows.columns) - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer() if shared.value else lambda _: 0.0
        for batch in batches:
            found = np.array([of(t.as_py()) for t in batch.column(n)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(found), pa.array((found >= threshold).astype(np.int32))], [*batch.schema.names[:n], "score", "predicted"]
            )

    schema = rows.drop(text).schema.add("score", "double").add("predicted", "integer")
    return rows.mapInArrow(task, schema)


def with_labels(docs: DataFrame, labels: DataFrame, column: str, max_marks: int = 1_000_000) -> DataFrame:
    """(text, label) of the rows of ``docs`` that ``labels`` (doc_id, ``column``) marks; null ids and labels mark nothing.

    An id marked twice counts once, as its greatest label.  Up to ``max_marks``
    marks, of 12 bytes each, go to the documents; more are joined by a shuffle
    whose result is stored, so that texts move once and not for every pass.
    """
    marks = checkpoint(labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).alias("label")))
    rows = docs.select("doc_id", "text")
    if marks.count() <= max_marks:
        return rows.join(F.broadcast(marks), "doc_id").select("text", "label")
    return stored(rows.join(marks, "doc_id").select("text", "label"))
