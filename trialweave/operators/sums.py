"""Sums of matrices over all rows of a table: tasks add up their own rows, and their sums are added some at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "slot int, task int, total binary"


def matrix_sums(rows: DataFrame, of: Callable[[np.ndarray], list[np.ndarray]], shapes: list[tuple[int, ...]], *, tasks_per_core: int = 16, fan_in: int = 64) -> list[np.ndarray]:
    """The sums of what ``of`` makes of all blocks of ``rows`` (columns of numbers, taken as a matrix): arrays of ``shapes``.

    ``of`` gets up to 10,000 rows at a time.  At most ``tasks_per_core`` tasks
    for each core send one array of each shape, and at most ``fan_in`` of them
    meet in a task, so that neither what is shuffled nor the largest group grows
    with the table; the driver gets one array of each shape.  Rows with nulls
    are the caller's to leave out.
    """
    n_tasks = max(1, tasks_per_core * rows.sparkSession.sparkContext.defaultParallelism)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(s) for s in shapes]
        for batch in batches:
            if batch.num_rows:
                block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.float64)
                for total, part in zip(totals, of(block), strict=True):
                    total += part
        who = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int32()), pa.array([who] * len(totals), pa.int32()), pa.array([t.tobytes() for t in totals], pa.binary())], ["slot", "task", "total"])

    def merge(table: pa.Table) -> pa.Table:
        order = np.argsort(table["task"].to_numpy(), kind="stable")  # sums are taken in one order, so that reruns agree to the last bit
        total = sum(np.frombuffer(table["total"][int(k)].as_py()) for k in order)
        return pa.table({"slot": table["slot"][:1], "task": table["task"].take(order[:1]), "total": pa.array([total.tobytes()], pa.binary())})

    sums = rows.coalesce(n_tasks).mapInArrow(task, _SCHEMA)
    while n_tasks > 1:
        n_tasks = -(-n_tasks // fan_in)
        merged = sums.withColumn("_group", F.floor(F.col("task") / fan_in).cast("int")).groupBy("slot", "_group").applyInArrow(merge, _SCHEMA)
        sums = merged.withColumn("task", F.floor(F.col("task") / fan_in).cast("int"))
    found = {r["slot"]: np.frombuffer(bytes(r["total"])) for r in sums.collect()}
    return [found[k].reshape(s) if k in found else np.zeros(s) for k, s in enumerate(shapes)]
