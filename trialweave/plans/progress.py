"""Accounts of how far a campaign is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import progress_bar


def progress(runs: DataFrame, keys: tuple[str, ...] = ("depth", "batch"), done: str = "success") -> DataFrame:
    """Per group: total, completed (``done`` is not null), successes, failures, success_rate in percent (0 if none completed), bar."""
    completed = F.count(done)
    successes = F.sum(F.when(F.col(done), 1).otherwise(0)).cast("long")
    out = runs.groupBy(*keys).agg(F.count("*").alias("total"), completed.alias("completed"), successes.alias("successes"))
    rate = F.when(F.col("completed") > 0, 100.0 * F.col("successes") / F.col("completed")).otherwise(0.0)
    return out.withColumn("failures", F.col("completed") - F.col("successes")).withColumn("success_rate", rate).withColumn("bar", progress_bar(F.col("completed"), F.col("total")))


def all_done(runs: DataFrame, done: str = "success") -> bool:
    """Whether every run has a datapoint."""
    return bool(runs.agg(F.coalesce(F.bool_and(F.col(done).isNotNull()), F.lit(True))).first()[0])


def render(row: dict) -> str:
    return f"{row['bar']} {row['completed']}/{row['total']}, {row['successes']} ok, {row['failures']} failed, {row['success_rate']:.1f} %"
