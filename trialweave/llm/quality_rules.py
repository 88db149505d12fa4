"""Quality rules whose cutoffs come from quantile sketches of each language and source.

Counts are made inside a row with built-in functions, without a shuffle.  For
each (language, source), each language and the whole table, mergeable quantile
sketches (Greenwald-Khanna, partial on the map side) of a few ratios give
robust fences: quartile plus or minus ``spread`` times the quartile distance,
and never tighter than ``slack``.  A group of fewer than ``min_group`` documents takes its
language's fences, or else those of all.  The fences are then joined to the
rows, which are kept if they pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, small_or_shuffled

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: ratio -> (expression over the counts, slack below or None, slack above or None)
RATIOS = {
    "mean_word": ("try_divide(word_chars, n_words)", 1.0, 1.5),
    "symbols": ("try_divide(n_symbols, n_words)", None, 0.1),
    "dup_lines": ("try_divide(n_dup_lines, n_words)", None, 0.05),
}


def _with_counts(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` as struct ``_doc`` beside the counts named; blank and null texts count zero."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), text.alias("_text"))
    # the words, joined by single spaces: what later steps need no regular expression for
    df = df.withColumn("_flat", F.trim(F.regexp_replace("_text", SPACE + "+", " ")))
    n_words = F.when(F.col("_flat") == "", F.lit(0)).otherwise(F.length("_flat") - F.length(F.replace(F.col("_flat"), F.lit(" "), F.lit(""))) + 1).cast("long")
    df = df.withColumn("n_words", n_words)
    out = {"n_words": F.col("n_words")}
    out["word_chars"] = (F.length("_flat") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long")
    out["n_symbols"] = F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long")
    out["n_dup_lines"] = (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")
    if "n_dup_lines" in names:
        df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    if "n_repeat_words" in names:
        df = _with_repeats(df)
        out["n_repeat_words"] = F.col("_repeats")
    # a predicate on counts that is pushed below the steps that make them repeats those steps in each place that uses
    # them, and so over and over; a column that changes with the row's place stops it here
    df = df.select("_doc", F.monotonically_increasing_id().alias("_place"), *[out[n].alias(n) for n in names])
    return df.select("_doc", *[F.when(F.col("_place") >= 0, F.col(n)).alias(n) for n in names])


def _with_repeats(df: DataFrame, width: int = 3) -> DataFrame:
    """Adds ``_repeats``: how many words lie in windows of ``width`` words that occur twice or more in the text.

    Window hashes are sorted with their places, equal neighbours give the
    repeated places, and sorted places give the words covered: n log n steps.
    """
    df = df.withColumn("_words", F.when(F.col("n_words") >= width + 1, F.split("_flat", " ", -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_places", F.when(F.size("_words") > width, F.sequence(F.lit(1), F.size("_words") - (width - 1))).otherwise(F.array().cast("array<int>")))
    window = lambda i: F.xxhash64(*[F.get("_words", i + (k - 1)) for k in range(width)])
    df = df.withColumn("_sorted", F.sort_array(F.transform("_places", lambda i: F.struct(window(i).alias("h"), i.alias("i")))))
    hash_at = lambda i: F.get(F.col("_sorted"), i)["h"]
    repeated = F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == hash_at(k - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(k + 1), F.lit(False)))
    df = df.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.transform("_at", lambda x, k: F.least(F.lit(width), F.coalesce(F.get(F.col("_at"), k + 1) - x, F.lit(width))))
    return df.withColumn("_repeats", F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x))


def _fences(rows: DataFrame, keys: list[str], spread: float, accuracy: int) -> DataFrame:
    quartiles = [F.percentile_approx(r, F.array(F.lit(0.25), F.lit(0.75)), accuracy).alias(r) for r in RATIOS]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *quartiles)
    out = []
    for r, (_, below, above) in RATIOS.items():
        q1, q3 = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        if below is not None:
            out.append((q1 - F.greatest(spread * (q3 - q1), F.lit(below))).alias(f"{r}_low"))
        if above is not None:
            out.append((q3 + F.greatest(spread * (q3 - q1), F.lit(above))).alias(f"{r}_high"))
    return found.select(*keys, "n", F.struct(*out).alias("fences"))


def _ratios(counted: DataFrame, lang: str, source: str, min_words: int) -> DataFrame:
    """lang, source and the ratios of the rows that fences are made from: a small table of numbers, kept for the sketches of all levels."""
    usable = counted.where(F.col("n_words") >= min_words)
    return checkpoint(usable.select(F.col(lang).alias("lang"), F.col(source).alias("source"), *[F.expr(e).cast("float").alias(r) for r, (e, _, _) in RATIOS.items()]))


def fences(rows: DataFrame, *, min_group: int = 30, spread: float = 3.0, accuracy: int = 2000) -> DataFrame:
    """(lang, source, fences) for each pair of them in ``rows`` (lang, source and the ratios); nulls are groups of their own."""
    pairs = _fences(rows, ["lang", "source"], spread, accuracy)
    langs = _fences(rows, ["lang"], spread, accuracy).where(F.col("n") >= min_group).select(F.col("lang").alias("of_lang"), F.col("fences").alias("lang_fences"))
    everything = _fences(rows, [], spread, accuracy).select(F.col("fences").alias("all_fences"))
    joined = pairs.join(langs, pairs["lang"].eqNullSafe(langs["of_lang"]), "left").join(F.broadcast(everything), how="left")  # one row
    chosen = F.when(F.col("n") >= min_group, F.col("fences")).otherwise(F.coalesce("lang_fences", "all_fences"))
    return joined.select("lang", "source", chosen.alias("fences"))


def _judged(counted: DataFrame, ratios: DataFrame, lang: str, source: str, min_words: int, max_repeat_percent: int, max_bytes: int, **how) -> DataFrame:
    """``counted`` (the five counts, and columns named ``lang`` and ``source``) with base_failed and kept; fences of up to ``max_bytes`` are broadcast."""
    limits = checkpoint(fences(ratios, **how).select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "fences"))
    width = F.coalesce(F.octet_length("of_lang"), F.lit(0)) + F.coalesce(F.octet_length("of_source"), F.lit(0)) + 96
    limits = small_or_shuffled(limits, max_bytes, width)
    rows = counted.join(limits, F.col(lang).eqNullSafe(F.col("of_lang")) & F.col(source).eqNullSafe(F.col("of_source")), "left")
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    within = F.lit(True)
    for r, (e, below, above) in RATIOS.items():
        value = F.expr(f"({e})").cast("float")
        if below is not None:
            within = within & F.coalesce(value >= F.col(f"fences.{r}_low"), F.lit(True))
        if above is not None:
            within = within & F.coalesce(value <= F.col(f"fences.{r}_high"), F.lit(True))
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & within)


def quality_rules(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, max_bytes: int = 32 << 20, **how) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for every row of ``docs`` (doc_id, text, lang, source).

    Null and blank texts have zero counts and fail the base rule; null language
    or source is a group of its own; repeated rows are judged alike; an empty
    table gives no rows; further columns are ignored.  Texts are read once: the
    counts are kept, and the fences made from them.
    """
    counted = _with_counts(docs.select("doc_id", "text", "lang", "source"), COUNTS)
    counted = checkpoint(counted.select(*[F.col(f"_doc.{c}").alias(c) for c in ("doc_id", "lang", "source")], *COUNTS))
    rows = _judged(counted, _ratios(counted, "lang", "source", min_words), "lang", "source", min_words, max_repeat_percent, max_bytes, **how)
    return rows.select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, max_bytes: int = 32 << 20, **how) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names.

    Texts are read twice, for the fences (without counting repeats) and for the
    verdict, and never moved.  Nulls, blank texts, repeated rows and empty
    tables are treated as by ``quality_rules``.
    """
    cheap = _with_counts(docs.select("lang", "source", "text"), [n for n in COUNTS if n != "n_repeat_words"])
    ratios = _ratios(cheap, "_doc.lang", "_doc.source", min_words)
    rows = _judged(_with_counts(docs, COUNTS), ratios, "_doc.lang", "_doc.source", min_words, max_repeat_percent, max_bytes, **how)
    return rows.where("kept").select("_doc.*")
