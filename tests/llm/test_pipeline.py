"""The pipeline's stages take effect, and its query gives what its stages give one after another."""

import brute

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "mixing", "packing"]
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        tables.append(docs)
        if name != "packing":
            assert docs.columns == columns
    start, good, cut, one, mix, packed = [spark.read.parquet(f"{SF}/documents.parquet"), *tables]
    texts = {r.doc_id: r.text for r in start.collect()}
    for r in good.collect():
        c = brute.counts(r.text)
        assert texts[r.doc_id] == r.text and c[0] >= 50 and 2 * c[4] <= c[0]
    assert cut.count() == good.count() and all(r.n_chars == len(r.text) for r in cut.collect())
    want = {c for _, _, c in brute.near_duplicates([(r.doc_id, r.text) for r in cut.collect()])}
    assert sorted(r.doc_id for r in one.collect()) == sorted(want)
    words = sum(len(brute.words(r.text)) for r in one.collect())
    assert 1.2 * words < sum(len(brute.words(r.text)) for r in mix.collect()) <= 1.6 * words
    assert packed.select("doc_id").distinct().count() == mix.select("doc_id").distinct().count()
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(corpus_pipeline.run(spark, SF)) == key(packed)


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, blank texts, repeated rows and an empty table go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = [" ".join(f"w{k}x{j}{'ab'[j % 2] * (j % 5)}" for j in range(70)) for k in range(12)]
    rows = [(k, t, "en" if k % 3 else None, "s" if k % 2 else None, len(t)) for k, t in enumerate(prose)]
    rows += [rows[3], (40, None, None, None, None), (41, "", "en", "s", 0), (None, prose[5], "en", "s", 1), (42, prose[7] + " end", "en", "s", 1)]
    rows += [(None, p.upper() + " q", None, "s", 1) for p in (prose[0][::-1], prose[1][::-1], prose[1][::-1])]  # two documents without ids
    for n, table in enumerate([rows, []]):
        docs = spark.createDataFrame(table, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{n}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{n}/{name}")
            if name == "simhash":
                ids = [r.doc_id for r in docs.collect()]
                # 3 and 5 are lines that two pages of a small site have: both are cut, and of the empty texts one stays
                assert sorted(i for i in ids if i is not None) == ([k for k in range(12) if k != 5] if table else [])
                assert ids.count(None) == (1 if table else 0)  # the other one is on two pages as well
            if k < 4:
                assert docs.columns == corpus_pipeline.COLUMNS
        assert (docs.count() > 0) == bool(table)
