"""Runners: what is evaluated at every point, under one output contract.

``apply`` adds ``output`` (null where the run failed) and ``success``.  A pure
function is a column expression and stays in generated code; an external
program or Python function runs through ``mapInPandas``, where each row's
exception becomes a failed row.
"""

from __future__ import annotations

import logging
import os
import random
import re
import shutil
import subprocess
import sys
import tempfile
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import model
from ..functions import random as rnd
from .samplers import Registry

log = logging.getLogger(__name__)


class Runner:
    """``name`` labels the columns success_<name> and runtime_sec_<name>."""

    def __init__(self, name: str = "runner", **_: Any):
        self.name = name

    def apply(self, df: DataFrame, parameters: Sequence[str], seed: int = 0) -> DataFrame:
        """``df`` with output, success and runtime_sec_<name> set."""
        raise NotImplementedError


class ExpressionRunner(Runner):
    """A runner that is a column expression."""

    def output(self, df: DataFrame, parameters: Sequence[str]) -> Column:
        raise NotImplementedError

    def succeeds(self, output: Column) -> Column:
        return output.isNotNull()

    def apply(self, df: DataFrame, parameters: Sequence[str], seed: int = 0) -> DataFrame:
        df = df.withColumn("_out", self.output(df, parameters))
        df = df.withColumn("success", F.coalesce(self.succeeds(F.col("_out")), F.lit(False)))
        df = df.withColumn("output", F.when(F.col("success"), F.col("_out")))
        return df.withColumn(f"runtime_sec_{self.name}", F.lit(0.0)).drop("_out")


class SumRunner(ExpressionRunner):
    """The sum of the named columns that exist; fails within ``tolerance`` of ``fail_if``."""

    def __init__(self, params_to_sum: Sequence[str] = (), fail_if: float | None = None, tolerance: float = 0.25, name: str = "sum_runner", **_: Any):
        super().__init__(name)
        self.params_to_sum, self.fail_if, self.tolerance = list(params_to_sum), fail_if, tolerance

    def output(self, df: DataFrame, parameters: Sequence[str]) -> Column:
        return model.total([F.col(c).cast("double") for c in df.columns if c in self.params_to_sum])

    def succeeds(self, output: Column) -> Column:
        return output.isNotNull() if self.fail_if is None else F.abs(output - float(self.fail_if)) >= self.tolerance


class SyntheticDoubleGaussianRunner(ExpressionRunner):
    """One- or two-dimensional double Gaussian of x (and y)."""

    def __init__(self, dimensions: int = 1, model_parameters: Sequence[float] | None = None, name: str = "synthetic_double_gaussian_runner", **_: Any):
        super().__init__(name)
        if dimensions not in (1, 2):
            raise ValueError("dimensions must be 1 or 2")
        self.dimensions = dimensions
        self.p = list(model_parameters or (model.GAUSSIAN_1D if dimensions == 1 else model.GAUSSIAN_2D))
        if len(self.p) != (7 if dimensions == 1 else 10):
            raise ValueError("wrong number of model parameters")

    def output(self, df: DataFrame, parameters: Sequence[str]) -> Column:
        for c in "xy"[: self.dimensions]:
            if c not in df.columns:
                raise KeyError(c)
        x = F.col("x").cast("double")
        return model.double_gaussian_1d(x, self.p) if self.dimensions == 1 else model.double_gaussian_2d(x, F.col("y").cast("double"), self.p)


def last_two(names: Sequence[str]) -> list[str]:
    """The two names c<number> of the largest numbers, largest first."""
    return sorted((n for n in names if re.fullmatch(r"c\d+", n)), key=lambda n: -int(n[1:]))[:2]


def checked_sleep(sleep_sec: Any) -> tuple[float, float]:
    """A number of seconds or bounds [low, high] of a uniform draw, as bounds."""
    if isinstance(sleep_sec, bool) or not isinstance(sleep_sec, int | float | list | tuple):
        raise TypeError("sleep_sec must be a number or [low, high]")
    low, high = (sleep_sec, sleep_sec) if isinstance(sleep_sec, int | float) else sleep_sec if len(sleep_sec) == 2 else (None, None)
    if low is None or low > high or low < 0:
        raise ValueError("sleep_sec must be [low, high] with 0 <= low <= high")
    return float(low), float(high)


def unlucky(fail_prob: float) -> str:
    return f"RuntimeError: the run failed because it was unlucky, fail_prob:{fail_prob}"


class ExampleRunner(ExpressionRunner):
    """c1 + c2 (the two largest-numbered c columns), failing at random with ``fail_prob``.

    A value that is no number fails its row.  With ``raise_failures`` a run that
    is unlucky has failed with an error, which stands in ``error_<name>``.
    ``sleep_sec`` is validated; the expression does not sleep.
    ``ExampleProcessRunner`` does, and runs the sum as a program.
    """

    def __init__(self, fail_prob: float = 0.0, raise_failures: bool = False, sleep_sec: Any = 0.01, name: str = "example_runner", **_: Any):
        super().__init__(name)
        self.fail_prob, self.raise_failures = float(fail_prob), raise_failures
        self.sleep = checked_sleep(sleep_sec)

    def output(self, df: DataFrame, parameters: Sequence[str]) -> Column:
        return model.total([F.col(c).try_cast("double") for c in last_two(df.columns)])

    def apply(self, df: DataFrame, parameters: Sequence[str], seed: int = 0) -> DataFrame:
        out = super().apply(df, parameters, seed)
        if self.fail_prob <= 0:
            return out
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in ("depth", "batch", "sample") if c in df.columns])
        fails = rnd.unit(seed, f"{self.name}/fail", key) < self.fail_prob
        out = out.withColumn("success", F.col("success") & ~fails).withColumn("output", F.when(~fails, F.col("output")))
        return out.withColumn(f"error_{self.name}", F.when(fails, F.lit(unlucky(self.fail_prob)))) if self.raise_failures else out


class FunctionRunner(Runner):
    """Any Python function ``single_code_run(run_dir, params) -> dict`` with a boolean ``success``.

    Rows go through in small Arrow batches; a row's exception, or an answer that
    breaks the contract, makes a failed row with the reason in ``error_<name>``.
    Every row has a scratch folder of its own, local to the task's attempt, of
    which ``keep`` ("all", "custom" with ``keep_files``, or "none") says what is
    moved to ``keep_dir`` before it is removed; rows are all that is returned.
    ``write_input(params, folder)`` may put input files there first.
    ``scratch_dir`` is where scratch folders are made: a path, or the name of
    an environment variable that holds one on each executor.
    """

    def __init__(self, function: Callable[[str, dict], dict], output_fields: dict[str, str] | None = None, keep: str = "none", keep_files: Sequence[str] = (), keep_dir: str | None = None, write_input: Callable[[dict, str], None] | None = None, name: str = "function_runner", **_: Any):
        super().__init__(name)
        self.write_input, self.scratch_dir = write_input, None
        self.function, self.keep, self.keep_files, self.keep_dir = function, keep, set(keep_files), keep_dir
        self.fields = {"output": "double"} | (output_fields or {})

    def _retain(self, scratch: str, row: dict) -> None:
        if self.keep == "none" or not self.keep_dir:
            return
        target = os.path.join(self.keep_dir, str(row.get("run_dir") or os.path.basename(scratch)))
        for file in os.listdir(scratch):
            if self.keep != "custom" or file in self.keep_files:
                os.makedirs(target, exist_ok=True)
                shutil.copy2(os.path.join(scratch, file), os.path.join(target, file))

    def one(self, row: dict, parameters: Sequence[str]) -> dict:
        start, scratch = time.perf_counter(), tempfile.mkdtemp(prefix="run-", dir=os.environ.get(self.scratch_dir or "", self.scratch_dir))
        try:
            if self.write_input is not None:
                self.write_input({p: row[p] for p in parameters}, scratch)
            answer = self.function(scratch, {p: row[p] for p in parameters})
            if not isinstance(answer, dict) or not isinstance(answer.get("success"), bool):
                raise KeyError("a runner returns a dict with a boolean success")
            out = {f: answer.get(f) for f in self.fields} | {"success": answer["success"], "error": None}
            if not out["success"]:
                out["output"] = None
            self._retain(scratch, row)
        except Exception as e:
            out = dict.fromkeys(self.fields) | {"success": False, "error": f"{type(e).__name__}: {e}"}
        finally:
            shutil.rmtree(scratch, ignore_errors=True)
        return out | {"runtime": time.perf_counter() - start}

    def apply(self, df: DataFrame, parameters: Sequence[str], seed: int = 0) -> DataFrame:
        error, runtime = f"error_{self.name}", f"runtime_sec_{self.name}"
        made = [*self.fields, "success", error, runtime]
        kept = [c for c in df.columns if c not in made]
        schema = T.StructType([df.schema[c] for c in kept])
        for f, kind in self.fields.items():
            schema = schema.add(f, kind)
        schema = schema.add("success", T.BooleanType()).add(error, T.StringType()).add(runtime, T.DoubleType())

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for start in range(0, len(pdf), 64):
                    part = pdf.iloc[start : start + 64]
                    found = [self.one(row, parameters) for row in part.to_dict("records")]
                    out = part[kept].copy()
                    for f in self.fields:
                        out[f] = [x[f] for x in found]
                    out["success"], out[error], out[runtime] = [x["success"] for x in found], [x["error"] for x in found], [x["runtime"] for x in found]
                    yield out

        return df.mapInPandas(task, schema)


class ProcessRunner(FunctionRunner):
    """An external program per row: ``command`` with {parameter} filled in; its last output line is ``output``."""

    def __init__(self, command: Sequence[str] | None = None, timeout: float | None = None, name: str = "process_runner", **more: Any):
        self.command, self.timeout = list(command or [sys.executable, "-c", "print({c1} + {c2})"]), timeout
        super().__init__(self._run, name=name, **more)

    def _run(self, scratch: str, params: dict) -> dict:
        command = [re.sub(r"\{(\w+)\}", lambda m: str(params[m[1]]) if m[1] in params else m[0], part) for part in self.command]
        done = subprocess.run(command, cwd=scratch, capture_output=True, text=True, timeout=self.timeout, check=True)
        with open(os.path.join(scratch, "output.txt"), "w", encoding="utf-8") as file:
            file.write(done.stdout)
        return {"output": float(done.stdout.strip().splitlines()[-1]), "success": True}


class ExampleProcessRunner(ProcessRunner):
    """The example as a program: sleeps ``sleep_sec`` (seconds, or [low, high] of a uniform draw), then prints the sum of c1 and c2.

    With ``fail_prob`` a run fails at random, the same runs each time, with an
    error if ``raise_failures``.
    """

    def __init__(self, fail_prob: float = 0.0, raise_failures: bool = True, sleep_sec: Any = 0.01, seed: int = 0, name: str = "example_process_runner", **more: Any):
        super().__init__(name=name, **more)
        self.sleep, self.fail_prob, self.raise_failures, self.seed = checked_sleep(sleep_sec), float(fail_prob), raise_failures, seed
        if not 0 <= self.fail_prob <= 1:
            raise ValueError("fail_prob must be between 0 and 1")

    def _run(self, scratch: str, params: dict) -> dict:
        one, two = last_two(list(params))
        draw = random.Random(f"{self.seed}:{sorted(params.items())}")
        self.command = [sys.executable, "-S", "-c", f"import time; time.sleep({draw.uniform(*self.sleep)}); print({float(params[one])} + {float(params[two])})"]
        answer = super()._run(scratch, params)
        if draw.random() < self.fail_prob:
            if self.raise_failures:
                raise RuntimeError(unlucky(self.fail_prob).removeprefix("RuntimeError: "))
            return {"output": None, "success": False}
        return answer


RUNNERS = Registry("trialweave.runners")
RUNNERS.add(SumRunner, SyntheticDoubleGaussianRunner, ExampleRunner, FunctionRunner, ProcessRunner, ExampleProcessRunner)


def make_runner(name: str, config: dict[str, Any]) -> Runner:
    config = dict(config)
    return RUNNERS.find(config.pop("type"))(**(config | {"name": name}))
