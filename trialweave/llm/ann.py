"""Approximate nearest neighbours by adaptive dimension scan over an inverted file.

A bounded sample fixes the centroids of the lists; every vector is put in its
nearest list.  A query probes the nearest lists.  Inside a list, vectors are
rotated by a random orthogonal matrix and laid out in blocks of columns; the
scan adds up a block at a time, and a candidate is abandoned as soon as its
partial distance, scaled to all dimensions and allowing for sampling error,
is significantly above the distance of the worst kept so far.  Survivors are
measured exactly on the original vectors in double precision.

Equal vectors are one class: the scan sees each distinct vector once, with the
few smallest ids that can matter, so that a vector repeated a billion times is
one row.  Lists are cut into blocks of bounded size, and so are the queries
that probe a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, small_or_shuffled, unit_hash


def rotation(dims: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, *, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """At most ``k`` centroids of ``x`` by Lloyd's method."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest(x, centres, 1)[:, 0]
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """For each row of ``x`` its ``n`` nearest centres, in no order."""
    out = np.empty((len(x), n), np.int64)
    norms = (centres * centres).sum(1)
    for start in range(0, len(x), 4096):
        d = norms - 2.0 * x[start : start + 4096] @ centres.T
        out[start : start + 4096] = np.argmin(d, 1)[:, None] if n == 1 else np.argpartition(d, n - 1, axis=1)[:, :n]
    return out


def scan(query: np.ndarray, rotated_query: np.ndarray, vectors: np.ndarray, blocks: list[np.ndarray], ids: np.ndarray, k: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and exact squared distances of (about) the ``k`` nearest of ``vectors``; ties go to smaller ``ids``.

    ``blocks`` are the rotated vectors' columns, some at a time.
    """
    n, dims = vectors.shape

    def exact(at: np.ndarray) -> np.ndarray:
        d = vectors[at] - query
        return np.einsum("ij,ij->i", d, d)

    def best(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids[at], d))[:k]
        return at[order], d[order]

    first = np.arange(min(n, max(k, 64)))
    at, kept = best(first, exact(first))
    start = len(first)
    while start < n:
        # growing batches: each starts from the bound that the ones before have reached
        stop = min(n, start + max(256, start))
        bound = kept[-1] * (1 + 1e-9) if len(kept) == k else np.inf
        alive, partial, seen = np.arange(start, stop), np.zeros(stop - start), 0
        for block in blocks:
            width = block.shape[0]
            gap = block[:, alive] - rotated_query[seen : seen + width, None]
            partial = partial + np.einsum("ij,ij->j", gap, gap)
            seen += width
            # H0: the full distance is within the bound; rejected if the scaled partial distance is too large for chance
            limit = bound * (seen / dims) * (1.0 + epsilon / np.sqrt(seen)) ** 2 if seen < dims else bound * (1 + 1e-9)
            stay = partial <= limit
            alive, partial = alive[stay], partial[stay]
            if not len(alive):
                break
        if len(alive):
            at, kept = best(np.concatenate([at, alive]), np.concatenate([kept, exact(alive)]))
        start = stop
    return at, kept


def share_to_probe(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, n_queries: int = 256) -> float:
    """The share of lists that holds ``recall`` of the ``k`` nearest of a sample's vectors, by brute force within the sample.

    Neighbours in a sample are farther away than those in the whole table, and
    so in lists no nearer: the share errs on the side of visiting more.
    """
    queries = sample[:n_queries]
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1.0
    of = nearest(sample, centres, 1)[:, 0]
    d = (sample * sample).sum(1) - 2.0 * queries @ sample.T
    d[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    order = np.argsort((centres * centres).sum(1) - 2.0 * queries @ centres.T, axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, of[near], axis=1).ravel()) + 1
    return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) / len(centres)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, vec) without null ids and null, empty, zero or non-finite vectors."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).where(F.coalesce(finite, F.lit(False)))


def _length(rows: DataFrame) -> int:
    """The most frequent length of ``rows.vec``, of several the greatest; 0 without rows."""
    sizes = rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    return sizes["dims"] if sizes else 0


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if len(column) else np.zeros((0, dims))


def search(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, lists: int | None = None, probe: float | None = None, recall: float = 0.97, sample_rows: int = 20_000, block_rows: int = 4096, epsilon: float = 2.1, column_block: int = 8, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its ``k`` nearest of ``vectors`` by Euclidean distance.

    A query never finds its own id.  Ties go to the smaller id.  ``queries``
    and ``vectors`` have the columns ``vec_id`` and ``embedding``; null, empty,
    zero and non-finite vectors, null ids, and vectors (queries too) of another
    length than most of ``vectors`` take no part.  With fewer than ``k``
    candidates all are returned; empty tables give no rows.  A row (id, vector)
    that is repeated any number of times is one candidate, and one query; rows
    of one id and different vectors are different candidates, and so are rows
    of one vector and different ids.  Other columns are ignored.

    ``lists`` defaults to about the square root of the number of distinct
    vectors, at most 4096; ``probe`` is the share of lists that a query visits,
    by default the share that holds ``recall`` of the neighbours within the
    sample (``share_to_probe``).  Centroids come from ``sample_rows`` vectors;
    every vector is indexed.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, vec_id, embedding)
    dims = _length(rows)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # equal rows are one; of equal vectors the k + 1 smallest ids are all that any query can need
    few = Window.partitionBy("vec").orderBy("vec_id")
    distinct = rows.where(F.size("vec") == dims).distinct().withColumn("_place", F.row_number().over(few)).where(F.col("_place") <= k + 1)
    classes = checkpoint(distinct.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = checkpoint(_usable(queries, vec_id, embedding).where(F.size("vec") == dims).distinct())
    n = classes.count()
    order = unit_hash("vec", salt=seed)
    share = min(1.0, 1.2 * sample_rows / n)
    sample = np.array([r[0] for r in classes.where(order <= share).orderBy(order).limit(sample_rows).select("vec").collect()] or [r[0] for r in classes.select("vec").limit(1).collect()])
    centres = kmeans(sample, lists or min(4096, max(1, int(np.sqrt(n)))), seed=seed + 1)
    probe = share_to_probe(sample, centres, k, recall) if probe is None else probe
    n_probe = max(1, min(len(centres), int(np.ceil(probe * len(centres)))))
    shared = spark.sparkContext.broadcast((centres, rotation(dims, seed)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = nearest(_matrix(batch.column(0), dims), shared.value[0], 1)[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(of), *batch.columns], ["list", "vec", "ids"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                of = nearest(_matrix(piece.column(0), dims), shared.value[0], n_probe)
                yield pa.RecordBatch.from_arrays([pa.array(of.ravel()), piece.column(0).take(pa.array(np.repeat(np.arange(piece.num_rows), n_probe)))], ["list", "vec"])

    member = classes.select("vec", "ids").mapInArrow(assign, "list long, vec array<double>, ids array<long>")
    goal = asked.select("vec").distinct()
    visits = goal.mapInArrow(visit, "list long, vec array<double>")
    # at most one row per list, and lists are at most 4096
    n_members = member.groupBy("list").agg(F.count("*").alias("n_members"))
    n_visits = visits.groupBy("list").agg(F.count("*").alias("n_visits"))
    parts = checkpoint(n_members.join(n_visits, "list").select("list", F.ceil(F.col("n_members") / block_rows).alias("blocks"), F.ceil(F.col("n_visits") / block_rows).alias("groups")))
    parts = small_or_shuffled(parts, 4096)
    some = lambda n: F.pmod(F.xxhash64("vec"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = member.join(parts, "list").select("list", "vec", "ids", some(F.col("blocks")).alias("block"), every(F.col("groups")).alias("part"))
    right = visits.join(parts, "list").select("list", "vec", some(F.col("groups")).alias("part"), every(F.col("blocks")).alias("block"))

    def compare(members: pa.Table, visitors: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if members.num_rows and visitors.num_rows:
            x, turn = _matrix(members["vec"].combine_chunks(), dims), shared.value[1]
            q, ids = _matrix(visitors["vec"].combine_chunks(), dims), members["ids"].to_pylist()
            turned, least = (x @ turn).T, np.array([i[0] for i in ids])
            blocks = [np.ascontiguousarray(turned[a : a + column_block]) for a in range(0, dims, column_block)]
            for query, rotated in zip(q, q @ turn, strict=True):
                at, d = scan(query, rotated, x, blocks, least, k + 1, epsilon)
                pairs = sorted((s, i) for s, a in zip(d.tolist(), at.tolist(), strict=True) for i in ids[a])[: k + 1]
                found.append((query, [i for _, i in pairs], [s for s, _ in pairs]))
        vec, near, dist = zip(*found, strict=True) if found else ([], [], [])
        return pa.table({"vec": pa.array(list(vec), pa.list_(pa.float64())), "near": pa.array(list(near), pa.list_(pa.int64())), "dist": pa.array(list(dist), pa.list_(pa.float64()))})

    keys = ["list", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "vec array<double>, near array<long>, dist array<double>")
    # one row per block: its k + 1 best; the best of all blocks are merged per distinct query vector
    pairs = F.transform(F.arrays_zip("dist", "near"), lambda p: F.struct(p["dist"].alias("d"), p["near"].alias("i")))
    merged = found.groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("best"))
    answers = asked.join(merged, "vec").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda p: p["i"] != F.col("vec_id")), 1, k).alias("best"))
    flat = answers.select("query_id", F.posexplode("best").alias("pos", "p"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("p.i").alias("vec_id"), F.sqrt("p.d").alias("score"))
