"""Scans of datapoints, summaries and histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

#: A comma that is not between quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def datapoints(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*/datapoint.csv", name_filter: str | None = None) -> DataFrame:
    """CSV files of a header and one row under ``folder``, each with its directory's name as ``run_dir``; missing and empty files give nothing.

    Columns are taken by each file's own header, in any order: what a file does
    not have, and malformed fields, are null.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    fields = [f for f in schema if f.name != "run_dir"]
    if not files.names(spark, folder):
        return spark.createDataFrame([], T.StructType(fields).add("run_dir", "string"))
    run_dir = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    lines = F.filter(F.split("value", r"\r?\n", -1), lambda x: F.trim(x) != "")
    files_ = spark.read.text(f"{folder}/{pattern}", wholetext=True).select(run_dir.alias("run_dir"), lines.alias("lines"))
    if name_filter:
        files_ = files_.where(F.col("run_dir").contains(name_filter))
    cells = lambda line: F.transform(F.split(line, _COMMA, -1), lambda x: F.replace(F.regexp_replace(F.trim(x), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"')))
    rows = files_.select("run_dir", cells(F.get("lines", F.lit(0))).alias("header"), F.explode(F.slice("lines", 2, 1 << 30)).alias("line")).withColumn("cells", cells(F.col("line")))
    value = lambda f: F.get("cells", (F.array_position("header", f.name) - 1).cast("int")).try_cast(f.dataType)
    return rows.select(*[value(f).alias(f.name) for f in fields], "run_dir")


def summary(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A summary CSV; an empty table if it does not exist."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def unseen(history: DataFrame, seen: DataFrame | None, skip: Sequence[str] = ()) -> DataFrame:
    """Rows of runs not taken in yet, without those whose run_dir contains a string of ``skip``."""
    for text in skip:
        history = history.where(~F.col("run_dir").contains(text))
    return history if seen is None else history.join(seen.select("run_dir").distinct(), "run_dir", "left_anti")


def parsed(results: DataFrame, parameter: str = "x") -> DataFrame:
    """run_dir, input and output of each run, as a parser hands them on."""
    return results.select("run_dir", F.col(parameter).cast("double").alias("input"), F.col("output").cast("double").alias("output"))


def objective(results: DataFrame, target: float = 2.0, parameter: str = "x") -> DataFrame:
    """inputs, objective = output - target (its distance with the sign turned for maximization), failure 0."""
    return results.select("run_dir", F.array(F.col(parameter).cast("double")).alias("inputs"), (F.col("output") - F.lit(float(target))).alias("objective"), F.lit(0).alias("failure"))
