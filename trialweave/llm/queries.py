"""The queries of this subpackage over the standard tables: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, fill_middle, itq, language_id, lexical, line_dedup, mixing, nb_classifiers, packing, quality_rules, simhash, substring
from .common import id_remainder
from .grams import Grams

TOXIC_GRAMS = Grams(chars=(3, 4, 5, 6), bits=19)
QUALITY_GRAMS = Grams(chars=(1, 2), words=(1, 2, 3), bits=18, lower=False, mark_repeats=True)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = id_remainder("doc_id", 4) == 2
    model = language_id.train(docs.where(~held_out).select("text", "lang"))
    return language_id.predict(docs, model, "doc_id", held_out.alias("held_out"))


def _labelled_scores(spark: SparkSession, sf_dir: str, column: str, threshold: float, learner: str, **how) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = id_remainder("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    model = nb_classifiers.train(nb_classifiers.with_labels(docs.where(~held_out), labels, column), learner, **how)
    return nb_classifiers.score(docs, model, threshold, "doc_id", held_out.alias("held_out"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_scores(spark, sf_dir, "toxic", 0.5, "logistic", grams=TOXIC_GRAMS, l2=1e-2)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir), width=35, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_boilerplate(_documents(spark, sf_dir).select("doc_id", "source", "text"), "source")
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled_scores(spark, sf_dir, "quality", 0.3, "hinge", grams=QUALITY_GRAMS, c=1.0, unit=True)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_documents(spark, sf_dir))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=50)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.restore(fill_middle.transform(_documents(spark, sf_dir)))
    digest = lambda text: F.sha2(F.col(text).cast("binary"), 256).alias(f"{text}_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_toxicity, op3_nearest, op4_substring_dedup, op5_line_dedup, op6_quality, op7_mixing, op8_packing, op9_simhash, op10_quality_rules, op11_lexical, op12_fill_middle, op13_embedding_dedup]
    return {f.__name__: f for f in found}


#: Line dedup for DuckDB: a line's pages over its site's pages, blank lines apart.
_LINE_SQL = r"""
WITH lines AS (
  SELECT rowid AS r, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)
), pages AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
boiler AS (
  SELECT l.source, line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY l.source, line
  HAVING count(DISTINCT r) >= 2 AND count(DISTINCT r) > 0.05 * max(pages)
), judged AS (
  SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


#: Substring dedup for DuckDB: windows by their text, words under a repeated one, and the rest.
_SUBSTRING_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT r, i FROM windows JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)),
gone AS (SELECT DISTINCT r, i + j AS p FROM repeated, range(35) u(j)),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) words ANTI JOIN gone USING (r, p) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Quality rules for DuckDB; quantiles are exact here, as the sketches are on groups below their accuracy.
_QUALITY_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
),
grams AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
repeated AS (SELECT r, i FROM grams JOIN (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1) USING (r, g)),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM repeated, range(3) u(j) GROUP BY r),
c AS (
  SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered USING (r)
),
q AS (SELECT *, CAST(word_chars::DOUBLE / n_words AS FLOAT) AS m, CAST(n_symbols::DOUBLE / n_words AS FLOAT) AS s, CAST(n_dup_lines::DOUBLE / n_words AS FLOAT) AS l FROM c),
u AS (SELECT * FROM q WHERE n_words >= 50),
g AS (
  SELECT grouping(lang) + grouping(source) AS level, lang, source, count(*) AS n,
    quantile_disc(m, 0.25)::DOUBLE AS m1, quantile_disc(m, 0.75)::DOUBLE AS m3, quantile_disc(s, 0.25)::DOUBLE AS s1, quantile_disc(s, 0.75)::DOUBLE AS s3,
    quantile_disc(l, 0.25)::DOUBLE AS l1, quantile_disc(l, 0.75)::DOUBLE AS l3
  FROM u GROUP BY GROUPING SETS ((lang, source), (lang), ())
),
f AS (
  SELECT level, lang, source, n, m1 - greatest(3 * (m3 - m1), 1.0) AS m_low, m3 + greatest(3 * (m3 - m1), 1.5) AS m_high,
    s3 + greatest(3 * (s3 - s1), 0.1) AS s_high, l3 + greatest(3 * (l3 - l1), 0.05) AS l_high FROM g
),
best AS (
  SELECT q.*, CASE WHEN a.n >= 30 THEN a ELSE CASE WHEN b.n >= 30 THEN b ELSE e END END AS t
  FROM q LEFT JOIN f a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM q.lang AND a.source IS NOT DISTINCT FROM q.source
  LEFT JOIN f b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM q.lang LEFT JOIN f e ON e.level = 2
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND coalesce(m >= t.m_low, true) AND coalesce(m <= t.m_high, true) AND coalesce(s <= t.s_high, true) AND coalesce(l <= t.l_high, true) AS kept
FROM best
"""

#: Ranked search for DuckDB: every term of every document, counted and scored.
_LEXICAL_SQL = r"""
WITH fold AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents, fold),
q AS (
  SELECT DISTINCT item_id, k, unnest(regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT item_id, text FROM benchmark)), fold
),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
scored AS (
  SELECT item_id, k, r, CAST(sum(weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(d.w) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN weights USING (term) JOIN tf USING (term) JOIN d USING (r), total GROUP BY item_id, k, r
),
placed AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""

#: Fill-in-the-middle for DuckDB: tokens by a pattern, pieces as slices of the list of tokens.
_FILL_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
h AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h
),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB text for the queries that SQL can express."""
    return {"op4_substring_dedup": _SUBSTRING_SQL, "op5_line_dedup": _LINE_SQL, "op10_quality_rules": _QUALITY_SQL, "op11_lexical": _LEXICAL_SQL, "op12_fill_middle": _FILL_MIDDLE_SQL}
