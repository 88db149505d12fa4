"""Well-spread choices from pools of any size: farthest-first over composable core-sets.

Farthest-first choice takes the row farthest from what has been chosen, again
and again; the distance of the next row, once k are chosen, is at most twice the
least radius with which k balls can cover the pool.  A choice of k from each
part of a pool, united, stands for the pool: choosing k from that union covers
all rows within four times the least radius.  Parts of bounded size are chosen
from in parallel, their choices united and chosen from again, until one part is
left.  A level is one shuffle and adds twice the least radius; there are two,
whatever k, where ``part_rows`` squared is at least k times the pool.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def farthest_first(x: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of ``k`` rows of ``x`` in the order of choice; ties, and the first of all without ``known``, go to the first row.

    A distance is that to the nearest of ``known`` and of the rows chosen
    before; infinite for the first if nothing is known.
    """
    gap = np.full(len(x), np.inf)
    for start in range(0, len(known)):
        gap = np.minimum(gap, ((x - known[start]) ** 2).sum(axis=1))
    places, distances = [], []
    for _ in range(min(k, len(x))):
        at = int(gap.argmax())
        places.append(at)
        distances.append(float(np.sqrt(gap[at])))
        gap = np.minimum(gap, ((x - x[at]) ** 2).sum(axis=1))
        gap[at] = -1.0  # never twice, whatever its copies
    return np.array(places, np.int64), np.array(distances)


def spread_choice(pool: DataFrame, k: int, vector: str, key: str, *, known: Sequence[Sequence[float]] = (), part_rows: int = 20_000, seed: int = 0) -> DataFrame:
    """rank, key, distance, vector of ``k`` rows of ``pool``, in the order of choice: each far from ``known`` and from those before.

    ``vector`` is an array of numbers and ``key`` a whole number that orders
    ties; rows whose vector is null or holds a null or a value that is not
    finite, or of another length than ``known`` or most rows, cannot be chosen,
    and neither can rows of null key.  Rows that are equal may both be chosen
    only where nothing else is left.  The choice depends on the keys and vectors
    alone, not on the partitions.  Parts are dealt by a hash of the key and
    hold about ``part_rows`` rows (rows of one key share a part).  ``known``
    goes to every task: a bounded list, such as the runs of a campaign so far.
    """
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = pool.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("key").isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).collect()
    dims = len(known[0]) if len(known) else (sizes[0]["dims"] if sizes else 0)
    rows = rows.where(F.size("vec") == dims)
    n = next((r["n"] for r in sizes if r["dims"] == dims), 0)
    fixed = np.array(known, float).reshape(-1, dims) if len(known) else np.zeros((0, dims))
    schema = "rank int, key long, distance double, vec array<double>"

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending")])
        x = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        keys = table["key"].to_numpy()
        order = np.lexsort((*x.T[::-1], keys))  # rows of one key by their vectors
        places, distances = farthest_first(x[order], k, fixed)
        taken = table.take(pa.array(order[places]))
        return pa.table({"rank": pa.array(range(1, len(places) + 1), pa.int32()), "key": taken["key"], "distance": pa.array(distances), "vec": taken["vec"]})

    parts = max(1, -(-n // part_rows))
    chosen = rows
    while True:
        part = F.pmod(F.xxhash64(F.lit(seed + parts), "key"), F.lit(parts))
        chosen = chosen.select("key", "vec", part.alias("_part")).groupBy("_part").applyInArrow(choose, schema)
        if parts == 1:
            return chosen.select("rank", F.col("key").alias(key), "distance", F.col("vec").alias(vector))
        # a level makes at most k rows of each part; parts of the next hold several of those choices
        parts = 1 if parts * k <= max(part_rows, 2 * k) else max(1, min(parts // 2, -(-parts * k // max(part_rows, 2 * k))))
