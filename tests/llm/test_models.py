"""Trained models by held-out accuracy and their parts by closed forms; nearest neighbours against brute force."""

import math
import zlib

import numpy as np
import pytest
from brute import Int, spark_hash
from pyspark.sql import functions as F

from trialweave.llm import ann, language_id, nb_classifiers, queries
from trialweave.llm.common import id_remainder
from trialweave.llm.grams import Grams, document_counts, sample_features

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string, held_out int"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_remainder_is_the_ids_crc(spark):
    rows = spark.createDataFrame([(k,) for k in [0, 7, 123456789, -5]] + [(None,)], "doc_id long").select("doc_id", id_remainder("doc_id", 5).alias("r")).collect()
    assert all(r.r == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 for r in rows)


def test_languages_of_held_out_documents(spark):
    found = queries.op1_language_id(spark, SF)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1000
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rows = [(k, "the cat and the hat sat " * 3, "en", "x", 1) for k in range(30)] + [(100 + k, "der hund und die katze " * 3, "de", "x", 1) for k in range(30)]
    rows += [(200, "no label", None, "x", 1), (None, "the hat", "en", "x", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs)
    assert model.languages == ["de", "en"] and model.temperature > 0
    odd = spark.createDataFrame([(1, None, None, "", 0), (2, "", None, "", 0), (3, "123 !?", None, "", 0), (4, "the cat sat", None, "", 0), (4, "die katze " * 200_000, None, "", 0)], DOCS)
    found = language_id.predict(odd, model, "doc_id").collect()
    assert [(r.doc_id, r.lang_pred) for r in found] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "de")]
    assert [r.score for r in found[:3]] == [0, 0, 0]
    assert language_id.train(docs.where("false")) is None
    assert {r.lang_pred for r in language_id.predict(odd, None, "doc_id").collect()} == {"und"}


def test_regularised_leader_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows = []
    for k in range(600):
        label = k % 3
        index = np.unique(np.concatenate([[label], rng.integers(3, 200, 20)]))
        rows.append((index, np.ones(len(index)) / math.sqrt(len(index)), label))
    w, b = language_id.ftrl(rows, 200, 3, alpha=1.0, beta=1.0, l1=0.5, l2=0.1, epochs=3)
    assert (w == 0).mean() > 0.5 and all(np.argmax(w[k]) == k for k in range(3))
    assert np.mean([np.argmax(x @ w[i] + b) == y for i, x, y in rows]) > 0.98


def test_temperature_undoes_overconfidence():
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1], 4000)
    y = (rng.random(4000) > p[:, 0]).astype(int)
    assert language_id.best_temperature(np.log(p) * 3, y) == pytest.approx(3, rel=0.15)


def test_document_counts(spark):
    g = Grams((1, 2), (1,), 12)
    rows = [("a", "xyz"), ("a", "xx"), ("b", None), ("b", "x")]
    found = document_counts(spark.createDataFrame(rows, "label string, text string").repartition(3), g)
    for label in "ab":
        want = np.zeros(g.size, int)
        for lab, t in rows:
            if lab == label:
                want[g.indicator()(t or "")] += 1
        assert found[label][0] == 2 and (found[label][1] == want).all()


def test_grams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    from trialweave.llm import grams

    g, text = Grams((1, 2, 3), (1, 2), 16), "ab cé " * 50
    whole = [x.tolist() for x in g.counts()(text)]
    monkeypatch.setattr(grams, "_PIECE", 7)
    assert [x.tolist() for x in g.counts()(text)] == whole


@pytest.mark.parametrize("query, column, threshold", [(queries.op2_toxicity, "toxic", 0.5), (queries.op6_quality, "quality", 0.3)])
def test_classifiers_on_held_out_documents(spark, labels, query, column, threshold):
    found = query(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in rows)
    held = [(r.score, r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for _, p, y in held]) > 0.88
    pos, neg = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.85


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(k, "bad awful words" if k % 2 else "fine pleasant prose", "en", "x", 1) for k in range(80)] + [(None, "x", "en", "", 1), (7, None, "en", "", 1)], DOCS)
    marks = spark.createDataFrame([(k, k % 2) for k in range(80)] + [(5, 0), (None, 1), (6, None)], "doc_id long, bad int")
    for max_marks in (0, 1000):
        labelled = nb_classifiers.with_labels(docs, marks, "bad", max_marks=max_marks)
        assert labelled.count() == 81 and labelled.where("label = 1").count() == 41
    for learner in ("logistic", "hinge"):
        model = nb_classifiers.train(labelled, learner, grams=Grams((2, 3), (1,), 14), unit=learner == "hinge")
        odd = spark.createDataFrame([(1, "awful words", "", "", 0), (2, "pleasant prose", "", "", 0), (3, None, "", "", 0), (4, "", "", "", 0), (5, "pleasant " * 300_000, "", "", 0)], DOCS)
        found = [r.score for r in nb_classifiers.score(odd, model, 0.5, "doc_id").orderBy("doc_id").collect()]
        assert found[0] > 0.5 > found[1] and found[2] == found[3] and 0 <= found[4] < 0.5
    assert nb_classifiers.train(labelled.where("label = 1"), "hinge", grams=Grams((2,), (), 12)) is None
    assert nb_classifiers.score(odd, None, 0.5, "doc_id").where("score <> 0 or predicted <> 0").count() == 0


@pytest.mark.parametrize("learner", ["logistic", "hinge"])
def test_mild_ratios_count(spark, learner):
    """Classes that differ only by how often they have a few words: in 60 of 100 texts or in 45."""
    r = np.random.default_rng(4)
    texts = [(" ".join(f"{'yes' if r.random() < (0.6 if y else 0.45) else 'not'}{k}" for k in range(12)), y) for y in (0, 1) for _ in range(400)]
    grams = Grams((), (1,), 14)
    model = nb_classifiers.train(spark.createDataFrame(texts, "text string, label int"), learner, grams=grams)
    of = model.scorer()
    pos, neg = ([of(t) for t, y in texts if y == want] for want in (1, 0))
    assert len({*pos, *neg}) > 100 and np.mean([a > b for a in pos for b in neg]) > 0.7


@pytest.mark.parametrize("learner", ["logistic", "hinge"])
def test_a_copied_text_does_not_fill_the_sample(spark, learner):
    """Seven thousand copies of each text in turn that would come first, against the same table without the copies."""
    r = np.random.default_rng(6)
    prose = lambda y: " ".join(r.choice(["bad", "vile", "sun"] if y else ["good", "calm", "sun"]) if r.random() < 0.3 else f"w{r.integers(60)}" for _ in range(12))
    rows = [(prose(y), y) for y in (0, 1) for _ in range(400)]
    test = [(prose(y), y) for y in (0, 1) for _ in range(200)]
    first = min((t for t, y in rows if y), key=lambda t: (spark_hash(Int(2), spark_hash(t)), spark_hash(t)))
    grams, found = Grams((), (1,), 16), []
    for copies in (0, 7000):
        df = spark.createDataFrame(rows + [(first, 1)] * copies, "text string, label int")
        of = nb_classifiers.train(df, learner, grams=grams, max_rows=600, unit=learner == "hinge").scorer()
        found.append(np.mean([(of(t) >= 0.5) == y for t, y in test]))
    assert found[0] > 0.85 and abs(found[0] - found[1]) <= 0.02


def test_a_copied_text_does_not_fill_a_language(spark):
    rows = [(" ".join(f"{'xyz'[k % 3]}{j * k % 17}" for j in range(9)), ["la", "lb", "lc"][k % 3]) for k in range(300)] + [("x1 x2 x3 lone", "la")] * 3000
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), grams=Grams((1, 2), (), 14), per_language=30)
    of = model.predictor()
    assert np.mean([of(t)[0] == la for t, la in rows[:300]]) > 0.98


@pytest.mark.parametrize("how", [{}, {"max_weights": 1 << 15}])
def test_every_language_is_learned(spark, how):
    """103 languages of their own words; fewer buckets where weights are bounded."""
    r = np.random.default_rng(1)
    words = [["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(6)] for _ in range(103)]
    rows = [(" ".join(r.choice(words[k], 8)), f"l{k:03}") for k in range(103) for _ in range(12)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.train(docs, **how)
    assert len(model.languages) == 103 and model.weights.size <= how.get("max_weights", 1 << 23)
    found = language_id.predict(docs, model, "lang").collect()
    assert np.mean([x.lang_pred == x.lang for x in found]) > (0.99 if not how else 0.9)
    assert len({x.lang for x in found if x.lang_pred == x.lang}) == 103


def test_kept_columns_with_the_names_of_new_ones(spark):
    rows = spark.createDataFrame([("aa bb", "la", 1, "x")] * 8 + [("cc dd", "lb", 0, "y")] * 8, "text string, lang string, score int, _text string")
    model = language_id.train(rows.select("text", "lang"), grams=Grams((1, 2), (), 12))
    found = language_id.predict(rows.withColumn("lang_pred", F.lit("old")), model, "score", "_text", "lang_pred", "lang")
    assert found.columns == ["_text", "lang", "lang_pred", "score"] and found.where("lang_pred <> lang or (lang = 'la') <> (_text = 'x')").count() == 0
    binary = nb_classifiers.train(rows.select("text", F.col("score").alias("label")), "hinge", grams=Grams((1, 2), (), 12))
    scored = nb_classifiers.score(rows.withColumn("predicted", F.lit("old")), binary, 0.5, "score", "predicted", "_text", F.col("score").alias("label"))
    assert scored.columns == ["_text", "label", "score", "predicted"] and scored.where("predicted <> label").count() == 0


def test_words_of_one_document_count(spark):
    rows = [(f"word{k}", k % 2) for k in range(100)]
    model = nb_classifiers.train(spark.createDataFrame(rows, "text string, label int"), "logistic", grams=Grams((), (1,), 18))
    assert np.count_nonzero(model.weights) >= 75  # all but those of texts held back
    of = model.scorer()
    assert np.mean([(of(t) > of("unseen")) == y for t, y in rows]) > 0.75


def test_counts_of_thousands_of_tasks_meet_in_small_groups(spark):
    from trialweave.llm import grams

    g, n = Grams((1, 2), (), 10), 2000
    rows = spark.range(n * 3).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"), F.concat(F.lit("x"), F.col("id") % 7).alias("text")).repartition(n)
    found = document_counts(rows, g, tasks_per_core=60, fan_in=16)
    want = {"a": np.zeros(g.size, np.int64), "b": np.zeros(g.size, np.int64)}
    for k in range(n * 3):
        want["a" if k % 3 == 0 else "b"][g.indicator()(f"x{k % 7}")] += 1
    assert {k: v[0] for k, v in found.items()} == {"a": n, "b": 2 * n} and all((found[k][1] == want[k]).all() for k in want)
    # the largest group of a sum: at most fan_in of the tasks' rows
    vectors = spark.range(480).select(F.lit("a").alias("label"), F.lit(0).alias("block"), F.col("id").cast("int").alias("task"), F.lit(1).cast("long").alias("n"), F.lit(grams._packed(np.full(4, 1 << 33))).alias("counts"))
    assert vectors.groupBy("label", "block", F.floor(F.col("task") / 16)).count().agg(F.max("count")).first()[0] == 16
    (one,) = grams._summed(vectors, 480, 16).collect()
    assert one.n == 480 and grams._unpacked(bytes(one.counts)).tolist() == [480 << 33] * 4


def test_counts_of_long_texts_are_not_cut(spark):
    rows = spark.createDataFrame([("a", "x" * 200_000 + "y"), ("a", None), ("b", "y")], "label string, text string")
    sample = sample_features(rows, Grams((1,), (), 12), per_label=9, max_entries=100, counts=True)
    assert sorted(sample.value.tolist()) == [1, 1, 200_000] and sorted(sample.labels) == ["a", "a", "b"]
    assert sample_features(rows.where("false"), Grams((1,), (), 12), per_label=9, max_entries=100, counts=True).labels == []
    assert len(sample_features(rows, Grams((1,), (), 12), per_label=9, max_entries=1, counts=True).index) <= 2


@pytest.mark.parametrize("query", [queries.op1_language_id, queries.op2_toxicity, queries.op6_quality])
def test_queries_of_models_on_empty_tables(spark, tmp_path, query):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert query(spark, str(tmp_path)).count() == 0


def test_log_ratios():
    r = nb_classifiers.log_ratios((10, np.array([9, 0, 1, 0])), (20, np.array([0, 19, 0, 0])))
    assert r[0] == pytest.approx(math.log((10 / 12) / (1 / 22))) and r[1] < 0 and r[2] > 0 and r[3] == 0


def test_dual_descent_and_logistic_find_the_separator():
    rng = np.random.default_rng(2)
    rows = nb_classifiers.Rows.__new__(nb_classifiers.Rows)
    x = rng.standard_normal((400, 5)) + 0.5
    rows.y = np.where(x @ [1, -2, 0.5, 0, 0] > 0, 1.0, -1.0)
    rows.index, rows.value = [np.arange(5, dtype=np.int32)] * 400, list(x.astype(np.float32))
    for w, b in (nb_classifiers.dual_coordinate_descent(rows, 5, c=10.0, epochs=50), nb_classifiers.logistic(rows, 5, l2=1e-6)):
        assert np.mean(np.sign(rows.margins(w, b)) == rows.y) > 0.97


# --- nearest neighbours ---


def brute(rows, ids, k):
    x = np.array([v for _, v in rows], float)
    names = np.array([i for i, _ in rows])
    out = {}
    for i, v in rows:
        if i in ids:
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
            order = [j for j in np.lexsort((names, d)) if names[j] != i][:k]
            out[i] = [(int(names[j]), float(d[j])) for j in order]
    return out


def found_by(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_search_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, {i for i, _ in rows if i % 100 == 0}, 10)
    found = found_by(queries.op3_nearest(spark, "/root/testdata/sf0.1"))
    assert found.keys() == want.keys()
    recall = np.mean([len({v for v, _ in found[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    exact = {i: np.array(v, float) for i, v in rows}
    for q, hits in found.items():
        assert hits == sorted(hits, key=lambda h: (h[1], h[0])) and all(s == pytest.approx(float(np.sqrt(((exact[q] - exact[v]) ** 2).sum())), abs=1e-12) for v, s in hits)


def test_search_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(6).tolist()) for k in range(60)]
    rows += [(100 + k, rows[3][1]) for k in range(40)]  # many equal vectors: ties by id
    good = list(rows)
    rows += [(200, None), (300, [0.0] * 6), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (600, [float("inf")] + [0.0] * 5), (700, [1.0, 2.0]), (None, [1.0] * 6), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vec", F.lit(1)).withColumn("list", F.lit("x")).repartition(3)
    found = found_by(ann.search(df, df.where("vec_id % 100 = 0"), k=10, probe=1.0, lists=4, block_rows=16))
    want = brute(good, {0, 100}, 10)
    assert found.keys() == want.keys()
    for q in want:
        assert [v for v, _ in found[q]] == [v for v, _ in want[q]]
    few = df.where("vec_id in (0, 1, 2)")
    assert {q: len(v) for q, v in found_by(ann.search(few, few, k=10)).items()} == {0: 2, 1: 2, 2: 2}
    assert ann.search(df.where("false"), df, k=3).count() == 0


def test_search_counts_repeated_rows_once(spark):
    """An id repeated more often than there are places, repeated queries, one id with two vectors, and vectors of other lengths."""
    rows = [(50, [1.0, 0.0])] * 20 + [(70, [1.0, 0.0]), (1, [1.01, 0.0]), (1, [1.01, 0.0]), (2, [2.0, 0.0]), (3, [2.4, 0.0]), (4, [9.0, 9.0]), (4, [0.5, 0.0])]
    rows += [(80 + k, [0.1 * k + 1, 5.0, 5.0, 5.0]) for k in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = found_by(ann.search(df, df.where("vec_id = 1"), k=3, probe=1.0))
    assert {q: [v for v, _ in hits] for q, hits in found.items()} == {1: [50, 70, 4]}
    assert [round(s, 9) for _, s in found[1]] == [0.01, 0.01, 0.51]
    everything = found_by(ann.search(df, df.where("vec_id = 1"), k=10, probe=1.0))
    assert [v for v, _ in everything[1]] == [50, 70, 4, 2, 3, 4]
    # the length that counts is the vectors', not the queries'
    long = spark.createDataFrame([(k, [float(k), 1.0, 2.0, 3.0]) for k in range(30)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, [5.0, 1.0, 2.0, 3.0]), (101, [1.0, 2.0]), (102, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert {q: [v for v, _ in hits] for q, hits in found_by(ann.search(long, asked, k=3, probe=1.0)).items()} == {100: [5, 4, 6]}
    assert ann.search(long, asked.where("false"), k=3).count() == 0


def test_search_visits_fewer_lists_where_lists_tell_more(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((20, 16)) * 6
    rows = [(k, (centres[k % 20] + rng.standard_normal(16)).tolist()) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want, found = brute(rows, set(range(0, 4000, 100)), 10), found_by(ann.search(df, df.where("vec_id % 100 = 0"), k=10))
    assert np.mean([len({v for v, _ in found[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9
    x = np.array([v for _, v in rows])
    lists = ann.kmeans(x, 63)
    assert ann.share_to_probe(x, lists, 10, 0.97) < 0.25
    flat = rng.standard_normal((4000, 64))
    assert ann.share_to_probe(flat, ann.kmeans(flat, 63), 10, 0.97) > 0.5
    assert ann.share_to_probe(x[:1], lists, 10, 0.97) == 1.0


def test_scan_abandons_only_what_is_far():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 32))
    turn = ann.rotation(32)
    assert np.allclose(turn @ turn.T, np.eye(32))
    blocks = [np.ascontiguousarray((x @ turn).T[a : a + 8]) for a in range(0, 32, 8)]
    hits = 0
    for q in x[:50]:
        at, d = ann.scan(q, q @ turn, x, blocks, np.arange(3000), 10, 2.1)
        full = ((x - q) ** 2).sum(1)
        hits += len(set(at.tolist()) & set(np.argsort(full)[:10].tolist()))
    assert hits >= 495
