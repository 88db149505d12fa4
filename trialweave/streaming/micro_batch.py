"""Runners, progress and feedback over Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runners import Runner
from ..plans.engine import run_sequence
from ..sources.store import Store


def evaluate(points: DataFrame, runners: Sequence[Runner], depth: int = 0, seed: int = 0) -> DataFrame:
    """Runners over a stream (or table) of points with a ``sample`` column: a stateless map."""
    return run_sequence(points, runners, depth, 0, seed)


def commit_stream(points: DataFrame, runners: Sequence[Runner], store: Store, checkpoint: str, depth: int = 0, seed: int = 0, feedback: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Evaluate a stream of points batch by batch into ``store``.

    A replayed micro-batch overwrites the same (level, batch) folder, so each is
    kept exactly once; ``feedback`` then sees the committed batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = run_sequence(batch, runners, depth, number, seed)
        store.write(rows, depth, number)
        if feedback is not None:
            feedback(store.batch(depth, number), number)

    return points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_progress(runs: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "2 hours", failed: str = "event_type = 'error'") -> DataFrame:
    """Completions and failures per window of event time; with a watermark on streams."""
    df = runs.withWatermark(time, late) if runs.isStreaming else runs
    out = df.groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("completed"), F.sum(F.when(F.expr(failed), 1).otherwise(0)).cast("long").alias("failures"))
    return out.select(F.col("w.start").alias("window_start"), "completed", "failures")
