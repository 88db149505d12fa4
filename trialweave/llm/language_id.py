"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all labelled rows.  The model is fitted on
a bounded sample of them, online, by follow-the-regularised-leader with
elastic-net penalties, which leaves most weights exactly zero.  A held-back
part of the sample then sets the temperature that calibrates probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import Grams, Sample, document_counts, sample_features, with_text

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    grams: Grams
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def predictor(self):
        count, weights = self.grams.counts(), self.weights.astype(np.float32)

        def of(text: str) -> tuple[str, float]:
            index, n = count(text)
            p = softmax((vector(index, n, self.idf) @ weights[index] + self.bias) / self.temperature)
            k = int(np.argmax(p))
            return self.languages[k], float(p[k])

        return of


def vector(index: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of one text, of unit length; term frequencies are damped by the logarithm."""
    x = (1.0 + np.log(np.maximum(n, 1))) * idf[index]
    return x / (np.sqrt(x @ x) or 1.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size x classes) and bias by FTRL-proximal with per-coordinate rates."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    penalty = np.full((size + 1, 1), l1)
    penalty[size] = 0.0  # the bias

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty[at], 0.0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for index, x, label in rows:
            at, values = np.append(index, size), np.append(x, 1.0)
            w = weights(at)
            error = softmax(values @ w)
            error[label] -= 1.0
            g = values[:, None] * error
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    full = weights(slice(None))
    return full[:size], full[size]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, *, grams: Grams = Grams((1, 2, 3), (), 16), per_language: int = 1000, max_rows: int = 8000, max_entries: int = 60_000_000, max_weights: int = 1 << 23, epochs: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5) -> LanguageModel | None:
    """Learn from the rows of ``docs`` (text, lang) whose lang is not null and whose text has a letter; None if there are none.

    Every value of lang is learned.  The model has a weight for each bucket and
    language, and goes to every task: with more than 128 languages n-grams are
    hashed into fewer buckets (at least 256), so that there are at most
    ``max_weights`` of them, 8 bytes each, up to 32,768 languages.  Bounds of the
    fit: of each language ``per_language`` distinct texts, chosen by their hash
    and each taken once however often it is repeated, but ``max_rows`` in all at
    most (one of each at least), the same number of each language; and
    ``max_entries`` different n-grams of those texts together.  Document
    frequencies cover every row, repeated ones as often as they come.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").alias("label"), "text")
    languages = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if not languages:
        return None
    bits = min(grams.bits, max(8, (max_weights // len(languages)).bit_length() - 1))
    grams = replace(grams, bits=bits)
    ((n_docs, found),) = document_counts(rows.select(F.lit("").alias("label"), "text"), grams).values()
    idf = np.log((1.0 + n_docs) / (1.0 + found)) + 1.0
    per_language = max(1, min(per_language, max_rows // len(languages)))
    sample = sample_features(rows, grams, per_label=per_language, max_entries=max_entries, counts=True, salt=1)
    return _fit(sample, grams, languages, idf, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2)


def _fit(sample: Sample, grams: Grams, languages: list[str], idf: np.ndarray, **how) -> LanguageModel:
    place = {name: k for k, name in enumerate(languages)}
    rows = []
    for k, label in enumerate(sample.labels):
        at = sample.row(k)
        rows.append((sample.index[at], vector(sample.index[at], sample.value[at], idf), place[label]))
    mix, seen, held, taught = np.random.default_rng(5).permutation(len(rows)), {}, [], []
    for k in mix:  # every fifth text of a language is held back
        seen[rows[k][2]] = seen.get(rows[k][2], 0) + 1
        (taught if seen[rows[k][2]] % 5 else held).append(rows[k])
    weights, bias = ftrl(taught, grams.size, len(languages), **how)
    logits = np.array([x @ weights[i] + bias for i, x, _ in held]).reshape(len(held), len(languages))
    return LanguageModel(grams, languages, idf, weights, bias, best_temperature(logits, np.array([y for _, _, y in held], int)))


def predict(docs: DataFrame, model: LanguageModel | None, *keep) -> DataFrame:
    """``keep`` columns, lang_pred and score for every row of ``docs`` (text).

    A null text, a text without any letter, and every text if there is no
    model, is ``und`` with score 0.  The model, of bounded size, goes to each
    task.  Kept columns named ``lang_pred`` or ``score`` give way to the new
    ones; others pass through, whatever their names.  Repeated rows are
    predicted each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, text = with_text(docs, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")), keep, ("lang_pred", "score"))
    n = len(rows.columns) - 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.predictor() if shared.value else None
        for batch in batches:
            found = [of(t.as_py()) if of and t.is_valid else (UNKNOWN, 0.0) for t in batch.column(n)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                [*batch.schema.names[:n], "lang_pred", "score"],
            )

    schema = rows.drop(text).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(task, schema)
