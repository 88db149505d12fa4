"""Combining parents with samples and runners' outputs with their inputs, under the column-order rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Beyond this many rows a batch of samples is not broadcast.
MAX_BROADCAST = 1_000_000
KEYS = ["depth", "batch", "sample"]


def cross_parents(parents: DataFrame | None, samples: DataFrame, n_samples: int, parent_index: str = "parent", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Every parent with every sample, parent-major: sample = parent * n + sample.

    A parameter that both have keeps the parent's place and the sample's value.
    Without parents the samples stand alone.
    """
    if parents is None:
        return samples
    new = [c for c in samples.columns if c != "sample"]
    right = samples.select(F.col("sample").alias("_s"), *[F.col(c).alias(f"_new_{c}") for c in new])
    rows = parents.crossJoin(F.broadcast(right) if n_samples <= max_broadcast else right)
    old = [c for c in parents.columns if c not in (parent_index, "run_dir", *KEYS)]
    columns = [F.col(f"_new_{c}" if c in new else c).alias(c) for c in old] + [F.col(f"_new_{c}").alias(c) for c in new if c not in old]
    return rows.select((F.col(parent_index) * n_samples + F.col("_s")).alias("sample"), *columns)


def ordered(df: DataFrame, runner: str, inputs: Sequence[str]) -> DataFrame:
    """Datapoint columns: the runner's, success_<runner>, the inputs not yet there, runtime, run_dir last."""
    made = [c for c in df.columns if c not in inputs and c not in KEYS and c != "run_dir" and not c.startswith("runtime_sec_")]
    first = list(dict.fromkeys(["output", *[c for c in made if c not in ("success", f"success_{runner}")], "success", f"success_{runner}"]))
    rest = [c for c in inputs if c not in first and c not in KEYS and c not in ("success", "run_dir")]
    runtime = f"runtime_sec_{runner}"
    tail = [c for c in (runtime,) if c not in rest] + ["run_dir"]
    df = df.withColumn(f"success_{runner}", F.col("success"))
    return df.select(*[c for c in KEYS if c in df.columns], *[c for c in [*first, *rest, *tail] if c in df.columns])


def union_batches(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns by name in order of first appearance, missing ones null."""
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
