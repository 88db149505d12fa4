"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A bounded sample fixes the codes: the centred directions are projected on their
principal axes, and a rotation is learned that brings them closest to the
corners of a cube, so that bits are balanced and say much; further rotations
from other starts give further bits.  The bits are cut into the keys of several
tables.  Vectors of one label that agree in any table's key are candidates, and
are compared by the cosine of the original vectors in double precision.

How many tables there are is measured on the sample: pairs exactly at the
threshold are made of sampled vectors, and tables are added until the wanted
share of those pairs meets in one of them.  Keys widen with the number of
vectors, so that the vectors in a key do not grow with it.

Equal vectors of a label are one class with a weight.  A key with more than
``block_rows`` classes is dealt to a grid of tasks.  A pair is counted in the
first table where it meets; tasks give sums for each class and the edges of a
spanning forest, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, small_or_shuffled, stored, told, unit_hash
from .components import connected_components
from .simhash import _roots


def directions(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def learned_rotation(v: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """The orthogonal matrix that brings the rows of ``v`` closest to corners of the cube, by alternating codes and rotation."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1], v.shape[1])))
    turn = q * np.sign(np.diag(r))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return turn


@dataclass(frozen=True)
class Codes:
    """Hyperplanes, one a bit: ``width`` of them make the key of a table."""

    centre: np.ndarray
    planes: np.ndarray  # dims x (tables * width)
    width: int

    @property
    def tables(self) -> int:
        return self.planes.shape[1] // self.width

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """rows x tables: the key of each row of directions in each table."""
        bits = (unit - self.centre) @ self.planes >= 0
        return bits.reshape(len(unit), self.tables, self.width) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))


def fit(sample: np.ndarray, *, width: int, threshold: float, recall: float, max_tables: int, seed: int = 0) -> Codes:
    """Codes for vectors like ``sample`` (directions): as many tables as give ``recall`` for pairs at the threshold."""
    centre = sample.mean(axis=0)
    spread = sample - centre
    _, axes = np.linalg.eigh(spread.T @ spread)
    projected = spread @ axes
    rng = np.random.default_rng(seed)
    ones = sample[rng.integers(0, len(sample), 4000)]
    away = rng.standard_normal(ones.shape)
    away -= np.einsum("ij,ij->i", away, ones)[:, None] * ones
    size = np.sqrt(np.einsum("ij,ij->i", away, away))[:, None]
    others = threshold * ones + np.sqrt(max(0.0, 1 - threshold**2)) * np.divide(away, size, out=np.zeros_like(away), where=size > 1e-9)
    planes, met = np.zeros((sample.shape[1], 0)), np.zeros(len(ones), bool)
    chosen: list[np.ndarray] = []
    while len(chosen) < max_tables and met.mean() < recall:
        while planes.shape[1] < width:
            planes = np.hstack([planes, axes @ learned_rotation(projected, seed + 1 + planes.shape[1] + len(chosen) * width)])
        chosen.append(planes[:, :width])
        planes = planes[:, width:]
        met |= (((ones - centre) @ chosen[-1] >= 0) == ((others - centre) @ chosen[-1] >= 0)).all(axis=1)
    return Codes(centre, np.hstack(chosen), width)


# --- comparison of candidates -------------------------------------------------


@dataclass
class Members:
    """Candidates side by side: class, weight, part of a dealt key, keys of all tables, direction."""

    node: np.ndarray
    weight: np.ndarray
    part: np.ndarray
    keys: np.ndarray
    unit: np.ndarray


def _linked(m: Members, a: np.ndarray, b: np.ndarray, table: np.ndarray | int) -> np.ndarray:
    """Which of the close pairs (a, b) have not met in an earlier table."""
    earlier = np.arange(m.keys.shape[1]) < np.broadcast_to(table, a.shape)[:, None]
    return ~((m.keys[a] == m.keys[b]) & earlier).any(axis=1)


def _small_groups(m: Members, table: np.ndarray, end: np.ndarray, threshold: float, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Close pairs of neighbours in sorted groups that end at ``end``, one distance after another."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    alive, k = np.arange(len(m.node)), 0
    while True:
        k += 1
        alive = alive[alive + k < end[alive]]
        if not len(alive):
            break
        for start in range(0, len(alive), 1 << 14):
            a = alive[start : start + (1 << 14)]
            b = a + k
            good = (np.einsum("ij,ij->i", m.unit[a], m.unit[b]) >= threshold) & ~(cross[a] & (m.part[a] == m.part[b]))
            a, b = a[good], b[good]
            new = _linked(m, a, b, table[a])
            found.append((a[new], b[new]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _large_group(m: Members, where: slice, table: int, threshold: float, cross: bool, degree: np.ndarray, root: np.ndarray) -> None:
    """All pairs of one group, block by block: adds to ``degree`` and joins ``root``."""
    at = np.arange(where.start, where.stop)
    step = max(1, (1 << 18) // len(at))
    for start in range(0, len(at), step):
        rows = at[start : start + step]
        i, j = np.nonzero(m.unit[rows] @ m.unit[at[start:]].T >= threshold)
        a, b = rows[i], at[start:][j]
        later = (a < b) & ~(cross & (m.part[a] == m.part[b]))
        a, b = a[later], b[later]
        new = _linked(m, a, b, table)
        _join(a[new], b[new], m.weight, degree, root)


def _join(a: np.ndarray, b: np.ndarray, weight: np.ndarray, degree: np.ndarray, root: np.ndarray) -> None:
    degree += np.bincount(a, weight[b], len(degree)).astype(np.int64) + np.bincount(b, weight[a], len(degree)).astype(np.int64)
    ra, rb = root[a], root[b]
    if (differ := ra != rb).any():
        ends = np.unique(np.stack([np.maximum(ra, rb), np.minimum(ra, rb)])[:, differ], axis=1)
        root[:] = _roots(len(root), ends[0], ends[1])[root]


def _compare(batches: Iterator[pa.RecordBatch], threshold: float, few: int = 48) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, table, key, cell): sums of links by class, and edges that connect what is linked."""

    def results(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        dims = len(table["vec"][0])
        column = lambda name: table[name].to_numpy()
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = Members(column("node"), column("weight"), column("part"), flat("keys").reshape(len(table), -1), directions(flat("vec").astype(np.float64).reshape(-1, dims)))
        tables, cross = column("at"), column("cross")
        sizes = np.diff(np.append(starts, len(table)))
        end = np.repeat(np.where(sizes <= few, starts + sizes, 0), np.maximum(sizes, 0))
        degree, root = np.zeros(len(table), np.int64), np.arange(len(table))
        _join(*_small_groups(m, tables, end, threshold, cross), m.weight, degree, root)
        for s, n in zip(starts[sizes > few].tolist(), sizes[sizes > few].tolist(), strict=True):
            _large_group(m, slice(s, s + n), int(tables[s]), threshold, bool(cross[s]), degree, root)
        linked = np.flatnonzero(degree)
        a, b, n = m.node[linked], m.node[root[linked]], degree[linked]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])

    held: list[pa.Table] = []  # the last group may go on in the next batch
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(map(len, held)) < 4096:
            continue
        table = pa.concat_tables(held)
        starts = _starts(table)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield results(table.slice(0, cut), starts[:-1])
            table = table.slice(cut)
        held = [table]
    if held and (table := pa.concat_tables(held)).num_rows:
        yield results(table, _starts(table))


def _starts(table: pa.Table) -> np.ndarray:
    """Where groups start in sorted rows."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for name in ("label", "at", "key", "cell"):
        column = table[name].combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


# --- the operator ---------------------------------------------------------------


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, recall: float = 0.997, sample_rows: int = 20_000, per_key: int = 32, max_tables: int = 64, block_rows: int = 4096, hot_rows: int = 1000, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Two rows link if their labels are equal and not null and the cosine of
    their vectors, in double precision, is at least ``threshold``; no pair below
    it links.  ``n_links`` counts the other rows linked directly,
    ``component_id`` is the least vec_id reachable over links, the row's own
    included, and ``kept`` tells whether it is the row's own.

    Null, empty, zero and non-finite vectors, vectors of another length than
    most, and rows of null label link with nothing: their component is their
    own id.  A null id names a component only if all of its ids are null, and
    such rows are kept.  Repeated rows are rows of their own, linked with each
    other, and all of them are kept if their id is their component's.  An empty
    table gives no rows; other columns are ignored, whatever their names.

    The sample of at most ``sample_rows`` directions fixes the codes only: every
    row is in every table.  Keys have log2(classes / ``per_key``) bits; tables
    are added until ``recall`` of pairs exactly at the threshold share a key
    (closer pairs do so more often), at most ``max_tables``.
    """
    spark = vectors.sparkSession
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"), F.col(label).alias("label"))
    usable = rows.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = usable.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = sizes["dims"] if sizes else 0
    takes_part = F.coalesce(F.col("label").isNotNull() & finite & (F.size("vec") == dims), F.lit(False))
    alone = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not dims:
        return alone
    # a class is the equal vectors of a label; ids of classes hold once they are written down
    counted = rows.where(takes_part).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = stored(counted.withColumn("node", F.monotonically_increasing_id()))
    n = classes.count()
    order = unit_hash("vec", salt=seed)
    share = min(1.0, 1.2 * sample_rows / n)
    sample = np.array([r[0] for r in classes.where(order <= share).orderBy(order).limit(sample_rows).select("vec").collect()] or [classes.select("vec").first()[0]], float)
    width = min(48, max(4, int(np.ceil(np.log2(max(1, n / per_key))))))
    shared = spark.sparkContext.broadcast(fit(directions(sample), width=width, threshold=threshold, recall=recall, max_tables=max_tables, seed=seed))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            keys = codes.keys(directions(x)).ravel() if len(x) else np.zeros(0, np.int64)
            bounds = np.arange(batch.num_rows + 1, dtype=np.int32) * codes.tables
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys))], [*batch.schema.names, "keys"])

    coded = classes.select("label", "node", "weight", "vec")
    coded = stored(coded.mapInArrow(code, coded.select("*").schema.add("keys", T.ArrayType(T.LongType()))))
    met = coded.select("label", F.posexplode("keys").alias("at", "key")).groupBy("label", "at", "key").agg(F.count("*").alias("n"))
    hot = met.where(F.col("n") > block_rows).select(F.col("label").alias("_label"), F.col("at").alias("_at"), F.col("key").alias("_key"), F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
    hot = small_or_shuffled(checkpoint(hot), 100_000)
    members = coded.select("*", F.posexplode("keys").alias("at", "key"))
    members = members.join(hot, (F.col("label") == F.col("_label")) & (F.col("at") == F.col("_at")) & (F.col("key") == F.col("_key")), "left")
    # part p of a dealt key goes to the cells (p, j) of all parts j: within its own cell all pairs are compared, elsewhere those across
    parts = F.coalesce("parts", F.lit(1))
    members = members.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cell = F.least("part", "other") * parts + F.greatest("part", "other")
    members = members.select("label", "at", "key", cell.alias("cell"), (F.col("part") != F.col("other")).alias("cross"), "part", "node", "weight", "keys", "vec")
    members = members.repartition("label", "at", "key", "cell").sortWithinPartitions("label", "at", "key", "cell")
    found = stored(members.mapInArrow(lambda b: _compare(b, threshold), "a long, b long, n long"))

    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.select("a", "b"))
    named = classes.select("node", "least").join(roots, "node").groupBy("root").agg(F.min("least").alias("component_id"))
    joined = roots.join(named, "root").select("node", "component_id").join(links, "node")
    component = F.when(F.col("links").isNotNull(), F.col("component_id")).otherwise(F.col("least"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long")
    answers = stored(classes.join(joined, "node", "left").select("label", "vec", n_links.alias("n_links"), component.alias("component_id"), "weight"))
    found = told(rows.where(takes_part), answers, ["label", "vec"], "weight", hot_rows).select("vec_id", "n_links", "component_id")
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).unionByName(alone)
