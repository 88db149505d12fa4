"""Mixing sources to target sizes by entropy balancing.

Every document gets a rate in (0, 2): the least change from rate 1, in the
entropy of bounded rates, that gives each source its target.  The solution is
an exponential tilt by size, rate = 2 / (1 + exp(-lambda * size / mean size)),
with one multiplier per source.  The convex dual is solved by Newton steps
over a (source, size) histogram, which is a mergeable summary of all documents:
each step is one aggregation by source, and sources converge side by side.

Rates become whole copies by order sampling: the whole part is taken, and the
fractional part's extra copies go to documents in order of (uniform hash /
fraction) until the source's target is met.  The cut is found from sums per
bin of that order, then row by row inside the one bin that holds it; it is one
number per source, and with it every document is decided where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, discard, small_or_shuffled, stored, unit_hash

MAX_RATE = 2.0
#: Beyond this multiplier a rate is its bound to double precision.
_FAR = 60.0
#: Bytes of tables of sources that are broadcast.
_MAX_BYTES = 32 << 20


def _near(sources: DataFrame, max_bytes: int) -> DataFrame:
    """A table of one row per source ``of``, to be joined: broadcast if it has at most ``max_bytes``."""
    return small_or_shuffled(sources, max_bytes, F.coalesce(F.octet_length("of"), F.lit(0)) + 64)


def _numbered(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``place``, the number of each source in code-point order, null last; no task sees them all."""
    rows = stored(sizes.select("source", "source_size").orderBy(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row per partition of the sort
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(starts), part == F.col("of_part")).select("source", "source_size", (F.col("before") + inside).alias("place"))


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5) -> DataFrame:
    """``sizes`` (source, source_size long) with ``target``: weighted shares of ``share`` times all sizes.

    Weights repeat over the sources in code-point order, null last.  A target
    stops at twice its source's size, and the excess is shared by weight among
    the rest until none is above: target = min(level * weight, 2 * size).  The
    level is raised from sums over the sources that are at their bound and the
    rest, which are a concave function of it, so that every step stays below
    the solution and the steps end as soon as no source reaches its bound.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights))
    rows = stored(_numbered(sizes).select("source", "source_size", weight.alias("w"), (MAX_RATE * F.col("source_size")).alias("bound")))
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        full = F.col("bound") < F.lit(level) * F.col("w")
        n, held, free = rows.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("bound")).otherwise(0.0)), F.sum(F.when(~full, F.col("w")).otherwise(0.0))).first()
        if n == n_full:
            break
        n_full, level = n, (total - held) / free if free else float("inf")
    return rows.select("source", "source_size", F.least("bound", F.lit(level) * F.col("w")).alias("target"))


def _rate(multiplier: Column, scaled: Column) -> Column:
    return MAX_RATE / (1.0 + F.exp(-F.greatest(F.least(multiplier * scaled, F.lit(_FAR)), F.lit(-_FAR))))


def multipliers(histogram: DataFrame, goal: DataFrame, *, steps: int = 200, tolerance: float = 1e-6, max_bytes: int = _MAX_BYTES) -> DataFrame:
    """(source, mean, multiplier): the dual's solution for ``goal`` (source, source_size, target) over ``histogram`` (source, size, n).

    Newton steps on the dual, kept inside a bracket that each step's gradient
    narrows or halves, so that they always settle; a source that has settled
    takes no more part.  RuntimeError if any has not after ``steps``.  A source
    whose target is its bound has an infinite multiplier, one of size zero has
    none.
    """
    mean = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    known = stored(goal.join(mean.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").where("mean > 0"))
    inner = known.where(F.col("target") < (1 - 1e-12) * MAX_RATE * F.col("source_size"))
    lam = stored(inner.select("source", "target", "mean", F.lit(0.0).alias("multiplier"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"), F.lit(float("inf")).alias("error")))
    worst = lam.agg(F.max("error")).first()[0]
    while worst is not None and worst > tolerance:
        if not steps:
            raise RuntimeError(f"the mix did not settle: some source is {worst:.2g} of its target away from it")
        steps -= 1
        at = _near(lam.where(F.col("error") > tolerance).select(F.col("source").alias("of"), "multiplier", "mean"), max_bytes)
        tilted = histogram.join(at, F.col("source").eqNullSafe(F.col("of")))
        scaled = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), scaled)
        sums = tilted.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
            F.sum(F.col("n") * F.col("size") * scaled * rate * (1.0 - rate / MAX_RATE)).alias("slope"),
        ).withColumnRenamed("source", "of")
        rows = lam.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        gap = F.col("target") - F.col("taken")
        rows = rows.withColumn("new_low", F.when(gap > 0, F.greatest("low", "multiplier")).otherwise(F.col("low")))
        rows = rows.withColumn("new_high", F.when(gap < 0, F.least("high", "multiplier")).otherwise(F.col("high")))
        step = gap / F.greatest("slope", F.lit(1e-300))
        newton = F.col("multiplier") + step
        # outside the bracket: half way, or twice as far while one side is still open
        inside = (newton > F.col("new_low")) & (newton < F.col("new_high")) & (F.abs(step) <= 8.0)
        half = (
            F.when(F.col("new_low") <= -1e9, F.least(F.lit(-1.0), 2.0 * F.col("multiplier")))
            .when(F.col("new_high") >= 1e9, F.greatest(F.lit(1.0), 2.0 * F.col("multiplier")))
            .otherwise((F.col("new_low") + F.col("new_high")) / 2.0)
        )
        error = F.when(F.col("taken").isNull(), F.col("error")).otherwise(F.abs(gap) / F.greatest("target", F.lit(1e-300)))
        moved = F.when(error <= tolerance, F.col("multiplier")).when(inside, newton).otherwise(half)
        before, lam = lam, stored(rows.select("source", "target", "mean", moved.alias("multiplier"), F.col("new_low").alias("low"), F.col("new_high").alias("high"), error.alias("error")))
        discard(before)
        worst = lam.agg(F.max("error")).first()[0]
    bound = known.where(F.col("target") >= (1 - 1e-12) * MAX_RATE * F.col("source_size"))
    return lam.select("source", "mean", "multiplier").unionByName(bound.select("source", "mean", F.lit(float("inf")).alias("multiplier")))


def _size() -> Column:
    # \S is anything but ASCII white space here, and ++ spares the matcher from remembering where to go back
    return F.coalesce(F.regexp_count("text", F.lit(r"\S++")), F.lit(0)).cast("long")


def _key() -> Column:
    """What a document's draw depends on: equal rows have equal draws, rows that merely share an id do not."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


class _Mix:
    """How many copies each document gets: fitted on ``rows`` (source, size, key), applied to any table with these columns."""

    def __init__(self, rows: DataFrame, weights: tuple[float, ...], share: float, seed: int, max_bytes: int):
        histogram = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
        by_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
        n_rows = by_source.agg(F.max("n")).first()[0] or 0
        goal = stored(targets(by_source, weights=weights, share=share))
        solved = goal.join(multipliers(histogram, goal, max_bytes=max_bytes).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        self.seed, self.max_bytes = seed, max_bytes
        #: as many bins as there are rows in a bin, of the largest source
        self.bins = max(4096, 1 << (n_rows.bit_length() + 1) // 2)
        self.solved = _near(stored(solved.withColumnRenamed("source", "of")), max_bytes)
        cuts = stored(self._cuts(self.rated(rows)))
        #: whether some rows of a source's last rank are taken and others are not: only rows without ids, or repeated ones
        self.tied = cuts.where("last.tie < last.ties").limit(1).count() > 0
        self.cuts = _near(cuts, max_bytes)
        discard(histogram)

    def rated(self, rows: DataFrame) -> DataFrame:
        """``rows`` with source_size, target, ``whole`` copies, the ``rank`` of a further one (null: none) and its ``bin``."""
        tilt = _rate(F.coalesce("multiplier", F.lit(0.0)), F.col("size") / F.col("mean"))
        rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("multiplier") == float("inf"), F.lit(MAX_RATE)).otherwise(tilt)
        out = rows.join(self.solved, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", rate)
        fraction = F.col("rate") - F.floor("rate")
        rank = F.when(fraction > 1e-9, F.try_divide(unit_hash("key", salt=self.seed), fraction))
        out = out.withColumn("whole", F.floor("rate").cast("long")).withColumn("rank", rank).drop("of", "rate", "mean", "multiplier")
        # ranks from 0 to 1 in the lower half of the bins, above in the upper half
        return out.withColumn("bin", F.floor(F.when(F.col("rank") < 1, F.col("rank")).otherwise(2.0 - F.try_divide(F.lit(1.0), F.col("rank"))) * (self.bins // 2)))

    def _cuts(self, rated: DataFrame) -> DataFrame:
        """(of, cut_bin, last): the bin where a source's target is met, and the last (rank, rows taken of it, rows of it) there; none if all are."""
        sums = rated.groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"), F.sum("size").alias("size"), F.first("target").alias("target"))
        of_source = Window.partitionBy("source")
        missing = F.col("target") - F.sum("sure").over(of_source)
        running = F.sum(F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)).over(of_source.orderBy(F.col("bin").asc_nulls_first()))
        over = sums.select("source", "bin", "size", missing.alias("missing"), running.alias("running")).where("bin is not null and running > missing")
        room = F.col("missing") - F.col("running") + F.col("size")
        cuts = stored(over.groupBy(F.col("source").alias("of")).agg(F.min_by(F.struct(F.col("bin").alias("cut_bin"), room.alias("room")), "bin").alias("c")).select("of", "c.*"))
        middle = rated.select("source", "size", "rank", "bin").join(_near(cuts, self.max_bytes), F.col("source").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("cut_bin")))
        by_rank = Window.partitionBy("source").orderBy("rank", "size")
        middle = middle.withColumn("sum", F.sum("size").over(by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        middle = middle.withColumn("tie", F.row_number().over(by_rank) - F.rank().over(Window.partitionBy("source").orderBy("rank")) + 1)
        middle = middle.withColumn("ties", F.count("*").over(Window.partitionBy("source", "rank")))
        taken = middle.where(F.col("sum") - F.col("size") / 2.0 <= F.col("room"))
        last = taken.groupBy(F.col("source").alias("of_last")).agg(F.max(F.struct("rank", "tie", "ties")).alias("last"))
        return cuts.join(last, F.col("of").eqNullSafe(F.col("of_last")), "left").select("of", "cut_bin", "last")

    def copies(self, rows: DataFrame) -> DataFrame:
        """``rows`` with source_size, target and ``copies``; only rows of exactly the last rank are compared with each other."""
        out = self.rated(rows).join(self.cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        more = (
            F.when(F.col("rank").isNull() | (F.col("bin") > F.col("cut_bin")), 0)
            .when(F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")), 1)
            .when(F.col("last").isNull() | (F.col("rank") > F.col("last.rank")), 0)
            .when((F.col("rank") < F.col("last.rank")) | (F.col("last.tie") == F.col("last.ties")), 1)
        )
        out = out.withColumn("more", more)
        if self.tied:
            among = F.row_number().over(Window.partitionBy("source").orderBy("key", "size"))
            ties = out.where(F.col("more").isNull()).withColumn("more", F.when(among <= F.col("last.tie"), 1).otherwise(0))
            out = out.where(F.col("more").isNotNull()).unionByName(ties)
        return out.withColumn("copies", F.col("whole") + F.col("more")).drop("whole", "rank", "bin", "cut_bin", "last", "more")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, seed: int = 7, max_bytes: int = _MAX_BYTES) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs`` (doc_id, text, source).

    ``size`` is the number of words (null text: 0), ``copies`` is 0, 1 or 2 and
    ``taken`` is copies * size.  Documents without words get no copies.  Null
    is a source of its own, last in order.  Rows of equal id and text get
    equal copies except at the cut of their source, where each counts.
    Reruns agree: nothing depends on partitions or arrival.  An empty table
    gives no rows; other columns are ignored.  Tables of sources are broadcast
    up to ``max_bytes`` and shuffled beyond.
    """
    rows = checkpoint(docs.select("doc_id", "source", _size().alias("size"), _key().alias("key")))
    out = _Mix(rows, weights, share, seed, max_bytes).copies(rows)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, seed: int = 7, max_bytes: int = _MAX_BYTES) -> DataFrame:
    """``docs`` with each row as often as ``mix`` takes it; all columns pass through, whatever their names.

    Texts are read twice, to count their words and to copy them; they are not
    moved, but for rows that tie at the cut of their source.  Rows that share
    an id, or have none, are documents of their own.
    """
    how = [docs["source"], _size().alias("size"), _key().alias("key")]
    found = _Mix(checkpoint(docs.select(*how)), weights, share, seed, max_bytes)
    rows = found.copies(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), *how))
    rows = rows.where("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("_doc.*")
