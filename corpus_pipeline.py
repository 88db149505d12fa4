"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, each stage over what its predecessor kept.

Stages take and return the columns of ``documents``; further columns, whatever
their names, end with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import line_dedup, mixing, packing, quality_rules, simhash
from trialweave.llm.common import discard, stored
from trialweave.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and their language's and source's fences."""
    return quality_rules.keep_good(docs).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their site's boilerplate lines; n_chars follows the text."""
    cut = line_dedup.drop_boilerplate(docs, "source")
    return cut.select("doc_id", "text", "lang", "source", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_dedup), ("mixing", mix), ("packing", pack)]

#: SQL cannot express XXH64 fingerprints, Newton steps or a tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last, which
    the packed rows are made from, goes when the application ends.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
