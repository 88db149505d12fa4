"""Samplers as table functions, so that SQL expands a table of parents: ``sample_points(TABLE(parents) PARTITION BY (key), configuration)``."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import DoubleType, LongType, StructType

from ..functions import space


def _unit_draw(seed: int, name: str, index: int) -> float:
    """What ``functions.random.unit`` gives, for one index."""
    import hashlib

    return int(hashlib.md5(f"{seed}:{name}:{index}".encode()).hexdigest()[:13], 16) / float(1 << 52)


def points(config: dict[str, Any]) -> Iterator[list[float]]:
    """The points of a sampler's configuration, one after another; the same as the sampler's own."""
    kind, bounds, names = config["type"], config["bounds"], config["parameters"]
    if kind == "ArraySampler":
        sizes = [len(b) for b in bounds]
        values = lambda i, k: float(bounds[k][i // math.prod(sizes[k + 1 :]) % sizes[k]])
        n = math.prod(sizes)
    elif kind == "GridSampler":
        sizes = [config["num_samples"]] * len(bounds) if isinstance(config["num_samples"], int) else config["num_samples"]
        n = math.prod(sizes)

        def values(i: int, k: int) -> float:
            at, (low, high) = i // math.prod(sizes[k + 1 :]) % sizes[k], bounds[k]
            return float(low) if sizes[k] == 1 else float(high) if at == sizes[k] - 1 else at * ((high - low) / (sizes[k] - 1)) + low

    elif kind == "RandomSampler":
        n, seed = int(config["budget"]), int(config.get("seed", 0))
        values = lambda i, k: bounds[k][0] + _unit_draw(seed, names[k], i) * (bounds[k][1] - bounds[k][0])
    elif kind == "SobolSequenceSampler":
        n = 1 << max(0, int(config["budget"]).bit_length() - 1)
        table = [space.sobol_directions(k)[: max(1, n.bit_length() - 1)] for k in range(len(bounds))]

        def values(i: int, k: int) -> float:
            gray, bits = i ^ (i >> 1), 0
            for j, v in enumerate(table[k]):
                bits ^= v if gray >> j & 1 else 0
            return bounds[k][0] + bits / 2.0**space.SOBOL_BITS * (bounds[k][1] - bounds[k][0])

    else:
        raise ValueError(f"{kind} is no sampler of table functions")
    for i in range(n):
        yield [values(i, k) for k in range(len(bounds))]


class SamplePoints:
    """Each row of the table beside each point: the columns that the table is partitioned by, ``sample``, and the parameters.

    Arguments are the table, partitioned by its key columns, and the sampler's
    configuration as JSON.  Null keys are keys like any other; a parameter that
    has the name of a key column replaces nothing and is refused.
    """

    @staticmethod
    def analyze(parents: AnalyzeArgument, config: AnalyzeArgument) -> AnalyzeResult:
        if not parents.isTable or not isinstance(config.value, str):
            raise ValueError("sample_points takes a table and a constant configuration in JSON")
        names, schema = json.loads(config.value)["parameters"], StructType()
        for field in parents.dataType.fields:
            schema.add(field.name, field.dataType, True)
        if clash := {*names, "sample"} & set(schema.names):
            raise ValueError(f"{sorted(clash)} are columns of the table already")
        schema.add("sample", LongType())
        for n in names:
            schema.add(n, DoubleType())
        return AnalyzeResult(schema)

    def eval(self, parents, config: str):
        if not hasattr(self, "made"):
            self.made = list(points(json.loads(config)))
        for k, point in enumerate(self.made):
            yield (*parents, k, *point)


def register(spark: SparkSession, name: str = "sample_points") -> None:
    """Make ``sample_points`` known to SQL."""
    spark.udtf.register(name, udtf(SamplePoints))
