"""Hashed character and word n-grams of whole texts, and the passes that count them over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .hashing import word_hashes

_AGAIN = np.uint32(0x5EAFCA11)
_PIECE = 1 << 18  # characters of a text taken at a time


@dataclass(frozen=True)
class Grams:
    """Which n-grams count as features, and into how many buckets (2 ** bits) they are hashed."""

    chars: tuple[int, ...] = (1, 2, 3)
    words: tuple[int, ...] = ()
    bits: int = 16
    lower: bool = True
    mark_repeats: bool = False  # a word equal to the one before it becomes one symbol for all such words

    @property
    def size(self) -> int:
        return 1 << self.bits

    def pieces(self, text: str) -> Iterator[np.ndarray]:
        """Bucket numbers of all n-grams of ``text``, with repetition, in pieces of bounded size."""
        if self.lower:
            text = text.lower()
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        longest = max(self.chars, default=1)
        for start in range(0, len(codes), _PIECE) if self.chars else ():
            part = codes[start : start + _PIECE + longest - 1]
            out, rolled = [np.zeros(0, np.int32)], part
            for n in range(1, longest + 1):
                if n > 1:
                    rolled = rolled[:-1] * np.uint32(0x01000193) + part[n - 1 :]
                if n in self.chars:
                    out.append(self._bucket(rolled[:_PIECE], n))
            yield np.concatenate(out)
        if self.words:
            hashes = (word_hashes(text.encode("utf-8", "surrogatepass")) >> np.uint64(32)).astype(np.uint32)
            if self.mark_repeats and len(hashes) > 1:
                hashes[1:][hashes[1:] == hashes[:-1]] = _AGAIN
            rolled, out = hashes, [np.zeros(0, np.int32)]
            for n in range(1, max(self.words) + 1):
                if n > 1:
                    rolled = rolled[:-1] * np.uint32(0x01000193) + hashes[n - 1 :]
                if n in self.words and len(rolled):
                    out.append(self._bucket(rolled, 64 + n))
            yield np.concatenate(out)

    def _bucket(self, rolled: np.ndarray, kind: int) -> np.ndarray:
        x = (rolled ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35)
        return (x >> np.uint32(32 - self.bits)).astype(np.int32)

    def indicator(self) -> Callable[[str], np.ndarray]:
        """text -> sorted distinct buckets."""

        def of(text: str) -> np.ndarray:
            found = np.zeros(0, np.int32)
            for piece in self.pieces(text):
                found = _runs(np.concatenate([found, piece]))[0]
            return found

        return of

    def counts(self) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
        """text -> (sorted distinct buckets, how often each)."""

        def of(text: str) -> tuple[np.ndarray, np.ndarray]:
            parts = [_runs(piece) for piece in self.pieces(text)]
            if len(parts) < 2:
                return parts[0] if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            total = np.zeros(self.size, np.int64)
            for index, n in parts:
                total[index] += n
            index = np.flatnonzero(total)
            return index.astype(np.int32), total[index]

        return of


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and how often each occurs; ``values`` is sorted in place."""
    values.sort()
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(first, append=len(values))


def document_counts(rows: DataFrame, grams: Grams, *, tasks_per_core: int = 16, fan_in: int = 128) -> dict[str | None, tuple[int, np.ndarray]]:
    """Over ``rows`` (label, text): for each label its documents, and the documents that have each bucket.

    Every task counts its rows in one vector per label, which is cut in blocks;
    blocks are summed over ``fan_in`` tasks at a time, and those sums again,
    until one is left.  Rows are taken by at most ``tasks_per_core`` tasks for
    each core, so what is shuffled is at most labels x buckets numbers for each
    of those tasks, whatever the size of the table, and a group of a sum has at
    most ``fan_in`` blocks of 16 KB.  The driver gets labels x buckets numbers:
    for a few labels.  Null texts count as empty, repeated rows as often as they
    come; an empty table gives no labels.
    """
    n_tasks = max(1, tasks_per_core * rows.sparkSession.sparkContext.defaultParallelism)
    block = min(grams.size, 1 << 12)
    width = grams.size // block

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, totals, n_docs = grams.indicator(), {}, {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if label not in totals:
                    totals[label], n_docs[label] = np.zeros(grams.size, np.int64), 0
                totals[label][of(text.as_py() or "")] += 1
                n_docs[label] += 1
        for label, total in totals.items():
            parts = total.reshape(width, -1)
            who = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * width, pa.string()), pa.array(range(width), pa.int32()), pa.array([who] * width, pa.int32()), pa.array([n_docs[label]] * width, pa.int64()), pa.array(map(_packed, parts), pa.binary())],
                ["label", "block", "task", "n", "counts"],
            )

    taken = rows.select(F.col("label").cast("string").alias("label"), "text").coalesce(n_tasks)
    vectors = _summed(taken.mapInArrow(task, _VECTORS), n_tasks, fan_in)
    out: dict[str | None, tuple[int, np.ndarray]] = {}
    for label, at, _, n, counts in vectors.collect():
        _, vector = out.setdefault(label, (n, np.zeros(grams.size, np.int64)))
        part = _unpacked(bytes(counts))
        vector[at * len(part) : (at + 1) * len(part)] = part
    return out


_VECTORS = "label string, block int, task int, n long, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """Whole numbers as bytes, four for each where they fit."""
    wide = counts.max(initial=0) >> 32
    return (b"8" if wide else b"4") + counts.astype("<i8" if wide else "<u4").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8" if blob[:1] == b"8" else "<u4", offset=1).astype(np.int64)


def _summed(vectors: DataFrame, n_tasks: int, fan_in: int) -> DataFrame:
    """One row for each label and block: sums over ``fan_in`` neighbours at a time of the ``n_tasks`` tasks' rows."""

    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(1, np.int64)
        for blob in table["counts"]:
            total = total + _unpacked(blob.as_py())
        n = int(np.sum(table["n"].to_numpy()))
        return pa.table({"label": table["label"][:1], "block": table["block"][:1], "task": table["task"][:1], "n": pa.array([n], pa.int64()), "counts": pa.array([_packed(total)], pa.binary())})

    while True:
        n_tasks = -(-n_tasks // fan_in)
        vectors = vectors.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).groupBy("label", "block", "task").applyInArrow(merge, _VECTORS)
        if n_tasks == 1:
            return vectors


@dataclass
class Sample:
    """Sparse rows: row k has the buckets index[start[k]:start[k + 1]]."""

    labels: list
    index: np.ndarray
    value: np.ndarray
    start: np.ndarray

    def row(self, k: int) -> slice:
        return slice(self.start[k], self.start[k + 1])


def sample_features(rows: DataFrame, grams: Grams, *, per_label: int, max_entries: int, counts: bool, useful: np.ndarray | None = None, salt: int = 0) -> Sample:
    """Features of a bounded sample of the distinct texts of ``rows`` (label, text).

    Of each label the ``per_label`` distinct texts of the least hashes are
    taken, each once, however often it is repeated; of those, label by label in
    turns, as many as have ``max_entries`` features together.  ``useful`` marks
    the buckets that count.  Texts are hashed where they lie; an estimate of a
    label's distinct texts gives the threshold that about twice ``per_label`` of
    their hashes lie below, only those are shuffled, and only the chosen texts
    are taken apart.  Null texts are empty; an empty table gives no rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(useful)
    keyed = rows.select(F.col("label").cast("string").alias("label"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("text"))
    order = [F.xxhash64(F.lit(salt), "key"), F.col("key")]
    # twice as many as are asked for lie below a threshold on the hash; only those are shuffled and ordered
    sizes = checkpoint(keyed.groupBy("label").agg(F.approx_count_distinct("key").alias("texts")))
    share = F.broadcast(sizes.select(F.col("label").alias("of"), ((2.0 * per_label + 200.0) / F.col("texts")).alias("share")))
    likely = keyed.join(share, F.col("label").eqNullSafe(F.col("of"))).where(order[0] / 2.0**64 + 0.5 < F.col("share"))
    least = likely.select("label", "key").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    chosen = checkpoint(least.withColumn("place", place).where(F.col("place") <= per_label))  # per_label rows of each label

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, indicate, mask, seen = grams.counts(), grams.indicator(), shared.value, set()
        for batch in batches:
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key in seen:
                    continue
                seen.add(key)
                text = batch.column(3)[k].as_py()
                index, value = count(text) if counts else (indicate(text), np.zeros(0, np.int64))
                if mask is not None:
                    keep = mask[index]
                    index, value = index[keep], value[keep] if counts else value
                made = [pa.array([len(index)], pa.int64()), pa.array([index.astype("<i4").tobytes()], pa.binary()), pa.array([value.astype("<u4").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c[k : k + 1] for c in batch.columns[:3]), *made], ["label", "key", "place", "n", "index", "value"])

    picked = keyed.join(F.broadcast(chosen), ["label", "key"]).select("label", "key", "place", "text")
    made = picked.mapInArrow(task, "label string, key long, place int, n long, index binary, value binary")
    # copies of a text in other tasks are the same features
    made = checkpoint(made.dropDuplicates(["label", "key"]))
    entries, last = 0, None
    for row in made.select("place", "label", "n").orderBy("place", "label").collect():
        entries += row["n"]
        if last is not None and entries > max_entries:
            break
        last = (row["place"], row["label"])
    if last is None:
        return Sample([], np.zeros(0, np.int32), np.zeros(0), np.zeros(1, np.int64))
    within = (F.col("place") < last[0]) | ((F.col("place") == last[0]) & (F.col("label") <= last[1]))
    found = made.where(within).orderBy("place", "label").select("label", "index", "value").collect()
    index = [np.frombuffer(bytes(r["index"]), "<i4") for r in found]
    value = [np.frombuffer(bytes(r["value"]), "<u4").astype(np.float32) for r in found] if counts else []
    start = np.concatenate([[0], np.cumsum([len(i) for i in index])])
    return Sample([r["label"] for r in found], np.concatenate(index), np.concatenate(value) if counts else np.zeros(0, np.float32), start)


def with_text(docs: DataFrame, text: Column, keep: tuple, made: tuple[str, ...]) -> tuple[DataFrame, str]:
    """The ``keep`` columns of ``docs`` but those named in ``made``, and ``text`` as the last column; and that column's name, which no other has."""
    kept = [c for c, name in zip(keep, docs.select(*keep).columns, strict=True) if name not in made]
    name = "_text"
    while name in docs.select(*kept).columns:
        name += "_"
    return docs.select(*kept, text.alias(name)), name
