"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the ASCII white space 0x09-0x0D and 0x20.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def _path(spark: SparkSession, path: str):
    """(file system, path) for Hadoop's calls."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at ``spark.checkpoint.dir`` and return its folder there, which goes when the application ends.

    Local sessions without that setting get a folder of their own.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
        fs, p = _path(spark, sc.getCheckpointDir())  # a folder of this application alone
        fs.deleteOnExit(p)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Like ``checkpoint``, as a Parquet table in the shared folder: for loops, and for tables that are read in part.

    A table that is read back starts a plan afresh, where a checkpoint carries
    on the constraints inferred so far, which grow with every round.
    ``discard`` deletes it after its last reader; the rest goes when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(table: DataFrame | None) -> None:
    """Delete a table made by ``stored`` that nothing reads any more."""
    if table is not None and (path := getattr(table, "_stored_at", None)):
        fs, p = _path(table.sparkSession, path)
        fs.delete(p, True)


def small_or_shuffled(df: DataFrame, max_rows: int, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is small; otherwise the join is left to a shuffle.

    Small means at most ``max_rows`` rows, or a sum of ``weight`` (how many
    values a row holds) of at most ``max_rows`` where rows vary in width.
    ``df`` must be cheap to count: a checkpoint or a written table.
    """
    if weight is not None:
        return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= max_rows else df
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def told(rows: DataFrame, answers: DataFrame, names: list[str], weight: str, hot_rows: int = 1000, max_hot: int = 100_000) -> DataFrame:
    """The inner join of ``rows`` and ``answers`` (a written table, one row for each key) on ``names``, which are not null.

    ``weight`` says how many rows a key has.  Keys of over ``hot_rows`` rows,
    and of over a ``max_hot``-th of all, are at most ``max_hot``: their answers
    are broadcast, so that no task gets all rows of such a key.
    """
    limit = max(hot_rows, (answers.agg(F.sum(weight)).first()[0] or 0) // max_hot)
    hot, rest = answers.where(F.col(weight) > limit), answers.where(F.col(weight) <= limit)
    cold = rows.join(F.broadcast(hot.select(*names)), names, "left_anti").join(rest, names)
    return rows.join(F.broadcast(hot), names).unionByName(cold)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on ``names``."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def unit_hash(*columns: Column | str, salt: int = 0) -> Column:
    """A uniform value in [0, 1) from the columns' values: the same on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
