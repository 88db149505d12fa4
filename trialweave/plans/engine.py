"""Campaigns: levels of batches, evaluated lazily, committed batch by batch, resumed and extended exactly once."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import run_dir
from ..operators.adaptive import BayesianOptimizationSampler
from ..operators.expand import cross_parents, ordered, union_batches
from ..operators.runners import Runner
from ..operators.samplers import Sampler
from ..sources import files, sinks
from ..sources.store import Commit, Store
from . import progress
from .config import Campaign, Level, load, parse

log = logging.getLogger(__name__)
#: Failed runs of a batch that go to the log, in the order of their samples; the table has all of them.
MAX_LOGGED = 100


def run_sequence(points: DataFrame, runners: Sequence[Runner], depth: int = 0, batch: int = 0, seed: int = 0) -> DataFrame:
    """Apply ``runners`` one after another to ``points`` (sample and parameters); failed rows go on to the next.

    Lazy: pure runners fold into one projection.
    """
    df = points.select(F.lit(depth).alias("depth"), F.lit(batch).alias("batch"), *points.columns)
    for k, runner in enumerate(runners):
        inputs = [c for c in df.columns if c not in ("depth", "batch", "sample", "run_dir")]
        parameters = [c for c in inputs if c != "success"]
        df = df.withColumn("run_dir", run_dir(F.col("depth"), F.col("batch"), F.col("sample"), F.lit(k)))
        df = ordered(runner.apply(df, parameters, seed), runner.name, inputs)
    return df


def expand(parents: DataFrame | None, samples: DataFrame, n_samples: int) -> DataFrame:
    return cross_parents(parents, samples, n_samples)


class Engine:
    """Runs a campaign against its store."""

    def __init__(self, spark: SparkSession, campaign: Campaign):
        self.spark, self.campaign = spark, campaign
        self.store = Store(spark, campaign.base_run_dir)

    def _proposal(self, sampler: Sampler, depth: int, number: int, spent: int) -> DataFrame | None:
        if not sampler.adaptive:
            return sampler.batch(self.spark, number, spent)
        results = self.store.level(depth)  # the level's own rows
        if isinstance(sampler, BayesianOptimizationSampler):
            return sampler.propose(self.spark, results, number, spent)
        return sampler.propose(self.spark, results, number)

    def _counts(self, sampler: Sampler, number: int, n: int, seen: int) -> int:
        """How much of the budget a batch uses."""
        if isinstance(sampler, BayesianOptimizationSampler) and not sampler.count_warmup and seen < sampler.initial:
            return 0
        return n

    def run_level(self, depth: int, level: Level) -> None:
        sampler, parents = level.sampler, self.store.parents(depth - 1) if depth else None
        done = self.store.commits(depth)
        spent, number = sum(c.submitted for c in done), len(done)
        while True:
            successes = sum(c.successes for c in self.store.commits(depth))
            points = self._proposal(sampler, depth, number, spent)
            if points is None:
                break
            n = points.count() if sampler.adaptive else sampler.batch_range(number, spent)[1]
            if n == 0:
                break
            counted = self._counts(sampler, number, n, successes)
            if spent + counted > sampler.budget:
                if self.campaign.overflow == "discard":
                    break  # a batch over the budget is not run at all
                left = sampler.budget - spent
                if left <= 0:
                    break
                points, n, counted = points.where(F.col("sample") < left), left, left
            rows = expand(parents, points, n)
            commit = self.store.write(run_sequence(rows, level.runners, depth, number, self.campaign.seed), depth, number, counted)
            spent += counted
            self._report(commit)
            number += 1

    def _line(self, c: Commit) -> str:
        rate = 100.0 * c.successes / c.rows if c.rows else 0.0
        return f"depth {c.depth}, batch {c.batch}: {c.rows} runs, {c.successes} ok, {c.failures} failed, {rate:.1f} %\n"

    def _report(self, c: Commit) -> None:
        log.info(self._line(c).rstrip())
        files.write_text(self.spark, f"{self.campaign.base_run_dir}/current_progress.txt", self._line(c))
        if self.campaign.log_failures and c.failures:
            failed = self.store.batch(c.depth, c.batch).where(~F.col("success")).orderBy("sample", "run_dir")
            for row in failed.limit(MAX_LOGGED).toJSON().collect():
                log.warning("failed: %s", row)
            if c.failures > MAX_LOGGED:
                log.warning("%s more failed runs are in the batch's table only", c.failures - MAX_LOGGED)

    def run(self, extend_by: dict[str, int] | None = None) -> DataFrame | None:
        """All levels in order; the last level's rows come back.

        ``fresh`` starts anew, ``resume`` goes on after the last committed
        batch, ``extend`` first adds to samplers' budgets (``extend_by``, or
        each sampler's ``extend`` option of the configuration).
        """
        c = self.campaign
        if c.run_mode == "fresh":
            self.store.clear()
        if c.run_mode == "extend":
            options = c.raw.get("samplers") or {}
            for level in c.levels:
                more = (extend_by or {}).get(level.sampler_name, (options.get(level.sampler_name) or {}).get("extend_budget", 0))
                level.sampler.extended(int(more))
        files.write_text(self.spark, f"{c.base_run_dir}/config/config.json", json.dumps(c.raw, default=str, indent=1))
        for depth, level in enumerate(c.levels):
            before = len(self.store.commits(depth))
            try:
                self.run_level(depth, level)
            finally:  # once for a level, from the records
                files.write_text(self.spark, f"{c.base_run_dir}/all_progress.txt", "".join(map(self._line, self.store.commits())))
            if len(self.store.commits(depth)) > before and depth + 1 < len(c.levels) and self.store.commits(depth + 1):
                self.store.drop_from(depth + 1)  # children of an incomplete parent level
        return self.store.level(len(c.levels) - 1)

    def summarize(self) -> DataFrame | None:
        """Exports of the last level: CSV, and Parquet, the long layout and metadata as configured."""
        out = self.store.level(len(self.campaign.levels) - 1)
        if out is None:
            return None
        base = self.campaign.base_run_dir
        sinks.write_csv(out, f"{base}/dataset_csv")
        if self.campaign.summary_datatype == "parquet":
            sinks.write_parquet(out, f"{base}/dataset_parquet")
        sinks.write_long(out, f"{base}/dataset_long")
        meta = [{"sampler": x.sampler_name, "runners": [r.name for r in x.runners]} for x in self.campaign.levels]
        sinks.write_metadata(out, f"{base}/metadata.json", {"run_groups": meta})
        if self.campaign.hdf5:
            try:
                sinks.write_hdf5(out, f"{base}/dataset.h5", metadata={"run_groups": meta})
            except RuntimeError as e:
                log.warning("%s", e)
        return out

    def progress(self) -> DataFrame:
        frames = [self.store.level(d) for d in range(len(self.campaign.levels))]
        return progress.progress(union_batches([f.select("depth", "batch", "success") for f in frames if f is not None]))


def run_campaign(spark: SparkSession, config: dict[str, Any] | str, extend_by: dict[str, int] | None = None) -> DataFrame | None:
    """Run a configuration (a dict, or the path of a YAML file) and export its summary."""
    engine = Engine(spark, parse(load(config) if isinstance(config, str) else config))
    engine.run(extend_by)
    return engine.summarize()
