"""Batches of runs that complete in any order: state per batch, closed when all are in or when time is up."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ACCOUNT = "batch long, status string, completed long, failures long, first_us long, last_us long"


class BatchAccount(StatefulProcessor):
    """Counts a batch's completions; tells of it once, as ``complete`` or, ``wait_ms`` of event time after its first, as ``expired``.

    Runs that come in after that are told apart as ``late``, one row for each
    micro-batch that has some.  A batch's state is dropped ``keep_ms`` after it
    was closed.
    """

    def __init__(self, expected: int, wait_ms: int, keep_ms: int):
        self.expected, self.wait_ms, self.keep_ms = expected, wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("account", "completed long, failures long, first_us long, last_us long, closed boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else (0, 0, None, None, False)
        completed, failures, first, last, closed = old
        late = late_failures = 0
        late_first = late_last = None
        for pdf in rows:
            for us, failed in zip(pdf["us"].tolist(), pdf["failed"].tolist(), strict=True):
                if closed:
                    late, late_failures = late + 1, late_failures + failed
                    late_first, late_last = min(us, late_first or us), max(us, late_last or us)
                    continue
                completed, failures = completed + 1, failures + failed
                first, last = us if first is None else min(us, first), us if last is None else max(us, last)
        if not closed:
            if old[0] == 0:
                self.handle.registerTimer(first // 1000 + self.wait_ms)
            if completed >= self.expected:
                closed = True
                for at in self.handle.listTimers():
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), last // 1000) + self.keep_ms)
                yield self._row(key, "complete", completed, failures, first, last)
            self.state.update((completed, failures, first, last, closed))
        if late:
            yield self._row(key, "late", late, late_failures, late_first, late_last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        completed, failures, first, last, closed = self.state.get()
        if closed:
            self.state.clear()
            return
        self.state.update((completed, failures, first, last, True))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        yield self._row(key, "expired", completed, failures, first, last)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: Any, status: str, completed: int, failures: int, first: int, last: int) -> pd.DataFrame:
        return pd.DataFrame({"batch": [key[0]], "status": [status], "completed": [completed], "failures": [int(failures)], "first_us": [first], "last_us": [last]})


def batch_accounts(runs: DataFrame, expected: int, *, time: str = "ts", batch: str = "batch", failed: str = "failed", late: str = "1 hour", wait_ms: int = 24 * 3600 * 1000, keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """batch, status, completed, failures, first_ts, last_ts: a stream of what becomes of batches of ``expected`` runs.

    ``runs`` is a stream with an event time; runs that come more than ``late``
    behind the watermark still count if their batch is open, and are told as
    ``late`` if it is not.  Rows with a null batch or time belong to no batch.
    Keyed by batch, so that a batch's runs meet in one task: at most
    ``expected`` of them count, and more are a count only.
    """
    rows = runs.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).where(F.col(batch).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(batch).cast("long").alias("batch"), F.unix_micros(time).alias("us"), F.coalesce(F.col(failed).cast("boolean"), F.lit(False)).alias("failed"), F.col(time))
    told = rows.groupBy("batch").transformWithStateInPandas(statefulProcessor=BatchAccount(expected, wait_ms, keep_ms), outputStructType=_ACCOUNT, outputMode="Append", timeMode="EventTime")
    return told.select("batch", "status", "completed", "failures", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"))
