"""Connected components of an undirected graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _with_least(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (v, u) with ``m``, the least u of each v.

    Nodes on more than ``limit`` rows are hubs: their minima are broadcast, and
    their rows spread over all tasks, so that none sees more than ``limit``
    rows of a node.
    """
    least = rows.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") > limit).select(F.col("v").alias("hub"), F.col("m").alias("hub_m"))
    others = least.where(F.col("n") <= limit).select(F.col("v").alias("of"), "m")
    dealt = rows.join(F.broadcast(hubs), F.col("v") == F.col("hub"), "left").withColumn("at", F.when(F.col("hub").isNull(), F.col("v")).otherwise(F.xxhash64("v", "u")))
    found = dealt.join(others, (F.col("at") == F.col("of")) & F.col("hub").isNull(), "left")
    return found.select("v", "u", F.coalesce("hub_m", "m").alias("m"))


def connected_components(edges: DataFrame, max_rounds: int = 50, *, hub_rows: int = 1000, max_hubs: int = 100_000) -> DataFrame:
    """``edges`` (a long, b long) -> (node long, root long): the smallest node of each node's component.

    Only nodes on an edge between two different nodes come back; null ends and
    loops are ignored, repeated edges count once, no edges give no rows.  A
    round shuffles the edges by node, but those of hubs: nodes on over
    ``hub_rows`` edges, and on over a ``max_hubs``-th of all, so that there are
    never more than ``max_hubs`` of them.  Each round is checkpointed, so its
    lineage does not grow.
    """
    links = checkpoint(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    )  # v > u
    before, n_links = None, links.count()
    for _ in range(max_rounds):
        both = links.select("v", "u").unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        limit = max(hub_rows, 2 * n_links // max_hubs)  # neither step has more rows than twice the links
        # large star: every larger neighbour of a node links to the least of the node's neighbourhood
        large = _with_least(both, limit).where("u > v").select(F.col("u").alias("v"), F.least("v", "m").alias("u")).distinct()
        # small star: every smaller neighbour, and the node itself, links to the least of them
        small = _with_least(large, limit).select(F.explode(F.array("v", "u")).alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        links = checkpoint(small)
        after = tuple(links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first())
        if after == before:
            break
        before, n_links = after, after[0]
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    stars = links.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
