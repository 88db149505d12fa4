"""The committed store: one Parquet folder per (level, runner step, batch) and a commit record written after it.

A batch's folder is overwritten as a whole, so doing a batch again after a
crash cannot double it; only batches with a record count.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


@dataclass(frozen=True)
class Commit:
    """What is known of a finished batch."""

    depth: int
    batch: int
    submitted: int
    rows: int
    successes: int

    @property
    def failures(self) -> int:
        return self.rows - self.successes


class Store:
    """One writer's view of a campaign's folder: records are read once and then kept."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._known: dict[tuple[int, int], Commit] | None = None

    def _folder(self, depth: int, batch: int) -> str:
        return f"{self.base}/data/depth={depth}/batch={batch}"

    def write(self, df: DataFrame, depth: int, batch: int, submitted: int | None = None) -> Commit:
        """Write a batch, then its record; ``submitted`` is how much of a budget it uses, by default its rows."""
        folder = self._folder(depth, batch)
        df.drop("depth", "batch").write.mode("overwrite").parquet(folder)
        found = self.spark.read.parquet(folder).agg(F.count("*"), F.coalesce(F.sum(F.col("success").cast("long")), F.lit(0))).first()
        commit = Commit(depth, batch, found[0] if submitted is None else submitted, found[0], found[1])
        files.write_text(self.spark, f"{self.base}/commits/d{depth}_b{batch}.json", json.dumps(asdict(commit)))
        self._records()[depth, batch] = commit
        return commit

    def _records(self) -> dict[tuple[int, int], Commit]:
        if self._known is None:
            texts = [files.read_text(self.spark, f"{self.base}/commits/{name}") for name in files.names(self.spark, f"{self.base}/commits") if name.endswith(".json")]
            self._known = {(c.depth, c.batch): c for c in (Commit(**json.loads(t)) for t in texts)}
        return self._known

    def commits(self, depth: int | None = None) -> list[Commit]:
        """Records in order of level and batch."""
        return [c for k, c in sorted(self._records().items()) if depth is None or k[0] == depth]

    def commit_table(self) -> DataFrame:
        """The records as rows (depth, batch, submitted, rows, successes)."""
        return self.spark.createDataFrame([tuple(asdict(c).values()) for c in self.commits()], "depth long, batch long, submitted long, rows long, successes long")

    def _rows(self, commits: list[Commit]) -> DataFrame | None:
        """The batches of ``commits`` as one scan; columns by name, missing ones null."""
        if not commits:
            return None
        reader = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.base}/data")
        df = reader.parquet(*[self._folder(c.depth, c.batch) for c in commits])
        return df.select("depth", "batch", *[c for c in df.columns if c not in ("depth", "batch")])

    def batch(self, depth: int, batch: int) -> DataFrame | None:
        return self._rows([c for c in self.commits(depth) if c.batch == batch])

    def level(self, depth: int) -> DataFrame | None:
        """All committed rows of a level."""
        return self._rows(self.commits(depth))

    def parents(self, depth: int) -> DataFrame | None:
        """The level's rows with ``parent``, their place in (batch, sample) order: sizes of batches are in the records."""
        commits = self.commits(depth)
        if not commits:
            return None
        starts = [0, *itertools.accumulate(c.rows for c in commits)]
        offsets = self.spark.createDataFrame([(c.batch, n) for c, n in zip(commits, starts, strict=False)], "batch int, _before long")  # a row per batch
        return self._rows(commits).join(F.broadcast(offsets), "batch").withColumn("parent", F.col("sample") + F.col("_before")).drop("_before")

    def drop_from(self, depth: int) -> None:
        """Forget levels from ``depth`` on."""
        for c in self.commits():
            if c.depth >= depth:
                files.delete(self.spark, f"{self.base}/commits/d{c.depth}_b{c.batch}.json")
                files.delete(self.spark, self._folder(c.depth, c.batch))
                del self._records()[c.depth, c.batch]

    def clear(self) -> None:
        self.drop_from(0)
