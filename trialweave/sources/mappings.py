"""Targets out of nested results: VARIANT columns, numeric leaves, and which of them is the objective."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_or_sum(value: Column) -> Column:
    """A VARIANT's number, the number that its text spells, or the sum of its array's numbers; null if it is none of these or holds anything else."""
    one = F.try_variant_get(value, "$", "double")
    many = F.try_variant_get(value, "$", "array<variant>")
    numbers = F.transform(many, lambda v: F.try_variant_get(v, "$", "double"))
    total = F.when(F.exists(numbers, lambda v: v.isNull()), F.lit(None).cast("double")).otherwise(F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b))
    return F.coalesce(one, F.when(many.isNotNull(), total))


def _sum_of(values: list[Column]) -> Column:
    """The sum of what is there of ``values``; null if nothing is."""
    there = F.coalesce(*values) if len(values) > 1 else values[0]
    total = F.coalesce(values[0], F.lit(0.0))
    for v in values[1:]:
        total = total + F.coalesce(v, F.lit(0.0))
    return F.when(there.isNotNull(), total)


def nested_target(payload: Column, names: Sequence[str]) -> Column:
    """The objective of a result given as VARIANT: the sum of the named fields; else ``output``, if it is a number or an array of numbers; else, if ``output`` is a mapping, the sum of its named fields; else the sum of those of its values that are numbers.

    Null where none of these exists.  A field that is there counts before all
    that come after, in that order.
    """
    field = lambda at: number_or_sum(F.try_variant_get(payload, at, "variant"))
    leaves = F.map_values(F.try_variant_get(payload, "$.output", "map<string,variant>"))
    numbers = F.filter(F.transform(leaves, number_or_sum), lambda v: v.isNotNull())
    total = F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, b: a + b))
    return F.coalesce(_sum_of([field(f"$['{n}']") for n in names]), field("$.output"), _sum_of([field(f"$.output['{n}']") for n in names]), total)


def with_nested_target(results: DataFrame, payload: str, names: Sequence[str], target: str = "output") -> DataFrame:
    """``results`` with ``target`` from ``payload`` (VARIANT, or JSON text: text that is not JSON has no target)."""
    column = F.col(payload)
    parsed = F.try_parse_json(column) if dict(results.dtypes)[payload] == "string" else column
    return results.withColumn(target, nested_target(parsed, names))


def deep_sum(results: DataFrame, key: str, payload: str, target: str = "output", max_depth: int = 64) -> DataFrame:
    """``key`` and the sum of all numeric leaves of ``payload`` (VARIANT) at any depth, in objects and arrays; null without any.

    Level by level: the numbers of a level are summed by ``key``, which is to be
    unique, and what is nested goes on to the next, until nothing is nested; a
    level costs a pass over what is left, and one more sum for each row that has
    any.  RuntimeError beyond ``max_depth`` levels.
    """
    level = results.select(F.col(key).alias("_key"), F.col(payload).alias("_value"))
    spark, found = results.sparkSession, []
    for _ in range(max_depth):
        found.append(level.select("_key", F.when(F.schema_of_variant("_value") != "STRING", F.try_variant_get("_value", "$", "double")).alias("_number")).where("_number is not null"))
        nested = level.where(F.schema_of_variant("_value").rlike("^(OBJECT|ARRAY)"))
        if not nested.limit(1).count():
            break
        nested.createOrReplaceTempView("_trialweave_nested")
        level = spark.sql("SELECT _key, e.value AS _value FROM _trialweave_nested, LATERAL variant_explode(_value) AS e")
    else:
        raise RuntimeError(f"values are nested in more than {max_depth} levels")
    total = found[0]
    for f in found[1:]:
        total = total.unionByName(f)
    sums = total.groupBy("_key").agg(F.sum("_number").alias(target))
    return results.select(key).join(sums, F.col(key) == F.col("_key"), "left").select(key, target)
