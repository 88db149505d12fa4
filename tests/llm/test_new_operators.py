"""Ranked search, fill-in-the-middle and near-duplicate vectors against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialweave.llm import fill_middle, itq, lexical, queries

# --- fill-in-the-middle -----------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "\n\t ", "a", " a", "a ", "é è  ü x", "one two  three\nfour\t", "\U0001f600 \U0001f600́ end", "a<P>b c", "<S>", "x <M", "y< P>", "a <P", ">b c d", "tail <", "S> head", "\x1c\x85 odd \x0b\x0c",
    "word " * 300 + "last", "z" * 5000, "あい " * 200, "<", "<<S", "a\rb",
]


def plain_fim(doc_id, text):
    text = text or ""
    u = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(u), "plain", None, None, text
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(u), form, len(prefix), len(middle), out


@pytest.mark.parametrize("piece", [1, 64, 4 << 20])
def test_fill_middle_equals_plain_version(spark, monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "_PIECE", piece)
    r = random.Random(3)
    rows = [(k, TEXTS[k % len(TEXTS)]) for k in range(300)] + [(None, "no id at all"), (7, "again"), (7, "again"), (-5, "minus one two")]
    rows += [(400 + k, "".join(r.choice("ab \n<>PSMé") for _ in range(r.randrange(60)))) for k in range(300)]
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, form string, output int, raw int").repartition(3)
    # the kernel is also called here, where the size of a piece is what the test says
    found = fill_middle.restore(fill_middle.transform(docs))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    want = [(*plain_fim(d, t), t or "") for d, t in rows]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert {"plain", "spm", "psm"} == {w[2] for w in want}


def test_fill_middle_kernel_takes_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fill_middle, "_PIECE", 40)
    texts = pa.array([None if t is None else t.encode() for t in TEXTS], pa.binary())
    slices = list(fill_middle._slices(texts))
    assert sum(n for _, n in slices) == len(TEXTS) and len(slices) > 5 and [a for a, _ in slices] == np.cumsum([0, *[n for _, n in slices]])[:-1].tolist()
    draws = [np.arange(len(TEXTS)) * p % 101 for p in (7, 11)] + [np.zeros(len(TEXTS), np.int64), np.arange(len(TEXTS)) * 50]
    whole = [c.to_pylist() for c in fill_middle.rearranged(texts, draws, 50, 80)]
    parts = [[c.to_pylist() for c in fill_middle.rearranged(texts.slice(a, n), [d[a : a + n] for d in draws], 50, 80)] for a, n in slices]
    assert [sum((p[k] for p in parts), []) for k in range(5)] == whole
    assert fill_middle.put_back(pa.array([t.encode() for t in whole[4]], pa.binary()), whole[1]).to_pylist() == [t or "" for t in TEXTS]


def test_fill_middle_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.restore(fill_middle.transform(empty)).count() == 0
    every = spark.createDataFrame([(k, f"a{k} b c") for k in range(50)], "doc_id long, text string")
    assert fill_middle.transform(every, fim_percent=100, spm_percent=0).where("form <> 'psm'").count() == 0
    odd = spark.createDataFrame([(None, None, "r"), ("<P>x", None, "r"), ("keep", "other", "r")], "output string, form string, restored string")
    found = fill_middle.restore(odd)
    assert found.columns == ["output", "form", "restored"] and sorted(r.restored for r in found.collect()) == ["", "<P>x", "keep"]


# --- ranked search ---------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(w for c in counts for w in c)
    out = []
    for item, text in set(items):
        found = []
        for (d, _), c in zip(docs, counts, strict=True):
            m = 50 + (50 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank + 1, None if none else d, -score) for rank, (score, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(r, n):
    words = [f"w{k}" for k in range(60)] + ["The", "naïve", "ÉTÉ", "x9", "日本", "a"]
    weights = [1 / (1 + k) for k in range(len(words))]
    docs = [(r.randrange(10_000), r.choice([" ", "-", ". ", "\n"]).join(r.choices(words, weights, k=r.choice([0, 1, 3, 30, 400])))) for _ in range(n)]
    docs += [(None, "w1 w2"), (None, "w1 w2"), (5, None), (6, ""), (7, "!? --"), docs[0]] + [(20_000 + k, "w3 w4 w59") for k in range(40)]
    r.shuffle(docs)
    items = [(k, " ".join(r.choices(words, k=r.choice([1, 4, 40])))) for k in range(25)] + [(100, None), (101, "--"), (102, "absent"), (3, "w5 W5 w5"), (None, "w7"), (4, "w9"), (4, "w9"), (200, "w3 w4 w59")]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"shard_documents": 7}, {"shard_documents": 1}, {"shard_postings": 25, "block_terms": 40}])
def test_search_equals_plain_version(spark, how):
    docs, items = corpus(random.Random(4), 250)
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, rank int").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("s")).repartition(2)
    found = lexical.search(frame, asked, k=9, **how)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(docs, items, 9)


def test_search_edge_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.where("false"), items).count() == 0 and lexical.search(docs, items.where("false")).count() == 0
    assert [tuple(r) for r in lexical.search(docs, items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]
    common = spark.createDataFrame([(k, "a") for k in range(2000)], "doc_id long, text string")
    assert lexical.search(common, items).count() == 0  # a term that all have weighs nothing


def test_terms_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = "ab, cdé-日本 x " * 40 + "q" * 100 + " end"
    raw = text.encode()
    want = [t.encode() for t in terms(text)]
    for piece in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(lexical, "_PIECE", piece)
        assert [w for part in lexical.term_lists(raw) for w in part] == want


def test_tree_counts_and_splits_less_than_everything():
    rng = np.random.default_rng(0)
    bits = rng.random(1000) < 0.3
    at = np.arange(1001)
    assert (lexical.Bits(bits).ones(at) == np.concatenate([[0], np.cumsum(bits)])).all()
    n = 4096
    document = np.concatenate([np.sort(rng.choice(n, 1500, replace=False)) for _ in range(6)])
    term, impact = np.repeat(np.arange(6), 1500), (rng.pareto(1.5, 9000) * 1000).astype(np.int64) + 1
    index = lexical.DualSorted(term, document, impact, n)
    query = lexical.Query(np.arange(6), np.array([3, 1, 4, 1, 5, 9]))
    best = lexical.Best(10)
    splits = lexical.search_shard(index, np.arange(n) * 2, np.ones(n, bool), query, best, batch=16)
    scores = np.zeros(n, np.int64)
    np.add.at(scores, document, impact * query.weights[term])
    want = [(int(scores[d]), True, -2 * int(d)) for d in np.lexsort((np.arange(n), -scores))[:10]]
    assert sorted(best.heap, reverse=True) == want and splits < n / 4
    assert lexical.search_shard(index, np.arange(n) * 2, np.ones(n, bool), query, best, batch=16) <= splits


# --- near-duplicate vectors ---------------------------------------------------------------


def plain_links(rows, threshold):
    """(vec_id, n_links, component) of (vec_id, vector, label)."""
    dims = Counter(len(v) for _, v, la in rows if v and la is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)).most_common(1)
    good = [v is not None and la is not None and bool(v) and len(v) == (dims[0][0] if dims else 0) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, la in rows]
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2]:
                a, b = (np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in (i, j))
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    degree[i] += 1
                    degree[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, degree[i], least.get(find(i)), d == least.get(find(i))) for i, (d, _, _) in enumerate(rows)), key=repr)


def vectors(rng, dims, n):
    rows = []
    for k in range(n):
        x = rng.standard_normal(dims)
        label = int(rng.integers(3))
        rows.append((k, x.tolist(), label))
        for j in range(rng.choice([0, 0, 1, 30])):
            y = x / np.linalg.norm(x) + rng.standard_normal(dims) * 0.12 / math.sqrt(dims)
            rows.append((1000 + 100 * k + j, (y * rng.choice([1, 7, 1e-3])).tolist(), label if j % 5 else 3))
    return rows


@pytest.mark.parametrize("how", [{}, {"block_rows": 4, "per_key": 2}, {"per_key": 1000, "block_rows": 10}, {"hot_rows": 0}])
def test_near_vectors_equal_plain_version(spark, how):
    rows = vectors(np.random.default_rng(6), 12, 40)
    rows += [(5000 + k, rows[0][1], rows[0][2]) for k in range(60)] + [rows[3], rows[3], (None, rows[0][1], rows[0][2]), (None, [1.0] * 12, 9)]
    rows += [(6000, None, 1), (6001, [0.0] * 12, 1), (6002, [1.0, None] + [0.0] * 10, 1), (6003, [float("nan")] * 12, 1), (6004, [float("inf")] * 12, 1), (6005, [1.0, 2.0], 1), (6006, [], 1), (6007, rows[0][1], None), (6008, [1e200] * 12, 7), (6009, [1e-200] * 12, 7)]
    df = spark.createDataFrame([(d, v, la, "x", 0) for d, v, la in rows], "vec_id long, embedding array<double>, label int, node string, weight int").repartition(4)
    found = itq.near_duplicates(df, **how)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = plain_links(rows, 0.98)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_near_vectors_edge_tables(spark):
    schema = "vec_id long, embedding array<float>, label string"
    assert itq.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    none = itq.near_duplicates(spark.createDataFrame([(1, None, "a"), (2, [0.0, 0.0], "a"), (3, [1.0, 2.0], None)], schema))
    assert sorted(map(tuple, none.collect())) == [(k, 0, k, True) for k in (1, 2, 3)]
    one = itq.near_duplicates(spark.createDataFrame([(5, [1.0, 2.0], "a"), (4, [2.0, 4.0], "a"), (3, [1.0, 2.0], "b"), (2, [2.0, -1.0], "a")], schema))
    assert sorted(map(tuple, one.collect())) == [(2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]


def test_near_vectors_of_the_standard_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([la for *_, la in rows])
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    found = {r.vec_id: r.n_links for r in queries.op13_embedding_dedup(spark, sf).collect()}
    want = dict(zip([d for d, *_ in rows], close.sum(1).tolist(), strict=True))
    assert all(found[d] <= n for d, n in want.items()) and sum(found.values()) >= 0.95 * sum(want.values())


def test_codes_meet_at_the_threshold_as_often_as_asked():
    rng = np.random.default_rng(1)
    x = itq.directions(rng.standard_normal((3000, 24)))
    codes = itq.fit(x, width=12, threshold=0.98, recall=0.99, max_tables=64)
    away = rng.standard_normal(x.shape)
    away -= np.einsum("ij,ij->i", away, x)[:, None] * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * itq.directions(away)
    met = (codes.keys(x) == codes.keys(y)).any(axis=1)
    assert met.mean() > 0.97 and (codes.keys(x)[:, 0][:, None] == codes.keys(x)[:, 0][None]).mean() < 0.01
    turn = itq.learned_rotation(rng.standard_normal((500, 8)), 0)
    assert np.allclose(turn @ turn.T, np.eye(8))
    v = rng.standard_normal((2000, 8)) @ np.diag([4, 3, 2, 1, 1, 1, 1, 1])
    loss = lambda r: np.square(np.where(v @ r >= 0, 1, -1) - v @ r).sum()
    assert loss(itq.learned_rotation(v, 0)) < loss(itq.learned_rotation(v, 0, rounds=0))
