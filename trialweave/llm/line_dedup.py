"""Boilerplate lines, found by how many of a site's pages contain them.

Per host, the pages that contain a line are divided by the host's pages; lines
above ``max_ratio`` go.  A page counts once for a line, however often it has
it.  Counting pre-aggregates before the shuffle, so a line on a third of all
pages costs one row per task.  A host has fewer than (lines per page /
max_ratio) boilerplate lines, so the rows joined back to the pages, one per
host, stay small; they are broadcast if there are few lines in all and
shuffled otherwise.  The lines that a page shares with its host's list are
found by hashing, and the page's lines looked up among them by halving where
they are many, so that a page of many such lines takes n log n steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _line_key(line: Column) -> Column:
    """128 bits that stand for a line, as text: arrays of texts are intersected by hashing."""
    return F.md5(line.cast("binary"))


def _holds(keys: Column, key: Column, few: int = 64) -> Column:
    """Whether the sorted ``keys`` hold ``key``: one by one if they are few, else by halving the stretch that may."""
    start = F.struct(F.lit(0).alias("low"), F.size(keys).alias("high"), key.alias("key"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.get(keys, middle) < s["key"]
        return F.struct(F.when(above, middle + 1).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high"), s["key"].alias("key"))

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(keys))))
    found = F.aggregate(rounds, start, halve, lambda s: F.coalesce(F.get(keys, s["low"]) == s["key"], F.lit(False)))
    return F.when(F.size(keys) <= few, F.array_contains(keys, key)).otherwise(found)


def boilerplate(docs: DataFrame, host: str = "source", *, max_ratio: float = 0.05, min_pages: int = 2) -> DataFrame:
    """(host, keys: the boilerplate lines' keys) for hosts that have any."""
    pages = docs.select(F.col(host).alias("host"), F.array_distinct(F.split("text", "\n", -1)).alias("lines"))
    n_pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode("lines").alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    counted = lines.groupBy("host", _line_key(F.col("line")).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    frequent = counted.join(n_pages.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host")))
    frequent = frequent.where(F.col("n") > max_ratio * F.col("pages"))
    return frequent.groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def _dealt(docs: DataFrame, rows: DataFrame, found: DataFrame, host: str, salt_pages: int) -> DataFrame:
    """``rows`` (_doc) left-joined with ``found`` (host, keys); the pages of large hosts go to as many tasks as they need."""
    sizes = docs.groupBy(F.col(host).alias("of")).agg(F.ceil(F.count("*") / salt_pages).cast("int").alias("salts")).where(F.col("salts") > 1)
    sizes = F.broadcast(checkpoint(sizes))  # a host in it has over salt_pages pages: at most one in salt_pages rows
    mine = F.col(f"_doc.`{host}`")
    spread = [F.col(f"_doc.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]  # what can be hashed
    rows = rows.join(sizes, mine.eqNullSafe(F.col("of")), "left").select("_doc", F.pmod(F.xxhash64(*spread), F.coalesce("salts", F.lit(1))).cast("int").alias("_salt"))
    copies = found.join(sizes, F.col("host").eqNullSafe(F.col("of")), "left").select("host", "keys", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return rows.join(copies, mine.eqNullSafe(F.col("host")) & (F.col("_salt") == F.col("salt")), "left").select("_doc", "host", "keys")


def drop_boilerplate(docs: DataFrame, host: str = "source", *, max_ratio: float = 0.05, min_pages: int = 2, max_keys: int = 500_000, salt_pages: int = 100_000) -> DataFrame:
    """``docs`` with the boilerplate lines cut from ``text``, and the columns n_lines and n_dropped added.

    Lines are split at line feeds and compared as they are; blank lines and
    lines on fewer than ``min_pages`` pages of the host stay (2 is the least
    that a repeat needs; beyond it the ratio decides).  Pages of null
    host form a site of their own.  A null text stays null with no lines; a
    text of boilerplate alone becomes empty.  Repeated rows are pages of their
    own.  An empty table gives no rows.  Other columns pass through, whatever
    their names, except ``n_lines`` and ``n_dropped``: the new ones replace
    them.  Up to ``max_keys`` boilerplate lines in all are broadcast; more are
    joined by a shuffle, where the pages of a host of over ``salt_pages`` are
    dealt to several tasks and the host's lines copied to each.
    """
    found = checkpoint(boilerplate(docs, host, max_ratio=max_ratio, min_pages=min_pages))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"))
    if (found.agg(F.sum(F.size("keys"))).first()[0] or 0) <= max_keys:
        rows = rows.join(F.broadcast(found), F.col(f"_doc.`{host}`").eqNullSafe(F.col("host")), "left")
    else:
        rows = _dealt(docs, rows, found, host, salt_pages)
    rows = rows.withColumn("_lines", F.split(F.col("_doc.text"), "\n", -1))
    hit = F.array_intersect(F.col("keys"), F.transform("_lines", _line_key))  # in the order of the first: sorted
    rows = rows.withColumn("_hit", F.when(F.col("keys").isNotNull(), hit))
    kept = F.filter("_lines", lambda x: ~_holds(F.col("_hit"), _line_key(x)))
    rows = rows.withColumn("_kept", F.when(F.coalesce(F.size("_hit"), F.lit(0)) <= 0, F.col("_lines")).otherwise(kept))
    columns = [F.array_join("_kept", "\n").alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_lines = F.when(F.col("_lines").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    n_kept = F.when(F.col("_kept").isNull(), 0).otherwise(F.size("_kept")).cast("long")
    return rows.select(*columns, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))
