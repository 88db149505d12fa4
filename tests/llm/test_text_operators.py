"""Operators on texts against brute force, on tables with nulls, empty and long texts, ties and repeated rows."""

import random
import zlib
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from trialweave.llm import line_dedup, mixing, packing, quality_rules, simhash, substring
from trialweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, hash int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, la, s, len(t or ""), "x", 1) for d, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    """Random prose with copies, near-copies, shared passages, blank and null texts, a long text and repeated rows."""
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6))) for _ in range(400)]
    prose = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\n", " \t", " x ", " # "]) for _ in range(n))
    passage = " ".join(prose(60).split())
    out = []
    for k in range(120):
        text = prose(r.randint(1, 160))
        if k % 4 == 0:
            text += " " + passage + " " + prose(5)
        out.append((k, text, r.choice(["en", "de", None]), r.choice(["a", "b", None])))
    out += [(200 + k, out[k % 7][1], "en", "a") for k in range(40)]
    out += [(300 + k, out[11][1].replace(" ", "  ").upper() + " tail" * k, "en", "b") for k in range(4)]
    out += [(400, None, "en", "a"), (401, "", None, None), (402, " \n\t", "en", "b"), (403, "one two", "en", "a"), (None, "one two", "en", "a")]
    out += [(404, prose(9000), "de", "b"), (405, ("x y z " * 300), "de", "b"), (7, out[7][1], out[7][2], out[7][3]), (406, "a\n\na\n a\nB\nB", "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).repartition(5).cache()


def pairs(rows):
    return [(d, t) for d, t, _, _ in rows]


def plain(df):
    return sorted([tuple(x) for x in df.collect()], key=repr)


@pytest.mark.parametrize("width", [5, 35])
@pytest.mark.parametrize("chunk_bytes", [1000, 1 << 22])
def test_remove_repeats(docs, rows, width, chunk_bytes):
    found = substring.remove_repeats(docs, width=width, chunk_bytes=chunk_bytes)
    assert plain(found.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute.remove_repeats(pairs(rows), width)
    assert found.where(F.sha2(F.col("kept_text").cast("binary"), 256) != F.col("kept_sha256")).count() == 0


def thue_morse(n):
    """A word of 2 ** n letters and its complement: equal under any polynomial modulo 2 ** 64 from n = 10 on."""
    bits = [bin(k).count("1") % 2 for k in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_under_polynomials_are_told_apart(spark):
    rows = []
    for n in (10, 11, 12):
        one, two = thue_morse(n)
        rest = [f"r{n}x{k}" for k in range(34)]
        rows += [(10 * n, " ".join([one, *rest])), (10 * n + 1, " ".join([two, *rest]))]
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 6 and all(x.n_removed == 0 for x in found)


def test_remove_repeats_of_a_shuffled_input(spark, docs, rows):
    """The passes agree on the deal even where rows come out of a shuffle, in no order."""
    mixed_up = docs.repartition(7, F.rand()).groupBy("doc_id", "text").agg(F.count("*").alias("n")).select("doc_id", "text", F.explode(F.array_repeat("n", F.col("n").cast("int"))))
    found = substring.remove_repeats(mixed_up, width=5, chunk_bytes=2000)
    assert plain(found.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute.remove_repeats(pairs(rows), 5)


def test_remove_repeats_survives_a_full_sketch(docs, rows):
    """A sketch too small to tell anything only costs time."""
    tiny = substring._SHARD_BITS
    substring._SHARD_BITS = 4
    try:
        flats = substring.Chunk.of(__import__("pyarrow").chunked_array([[t.encode() for _, t in pairs(rows) if t]]), 35, both=True)
        assert len(flats.place) == len(flats.hash_a)
    finally:
        substring._SHARD_BITS = tiny
    found = substring.remove_repeats(docs, width=35, depth=1, cells_per_byte=1e-9, chunk_bytes=3000)
    assert plain(found.select("doc_id", "n_words", "n_removed", "kept_sha256")) == brute.remove_repeats(pairs(rows), 35)


def test_near_duplicates(docs, rows):
    assert plain(simhash.near_duplicates(docs)) == brute.near_duplicates(pairs(rows))


def test_keep_one(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute.near_duplicates(pairs(rows))}
    assert sorted(x.doc_id for x in kept.collect()) == sorted(want)


def test_keep_one_tells_documents_of_one_id_apart(spark):
    """Id 1 names two documents that are no near-duplicates; one has a copy under id 2, the other under id 3."""
    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in ("red", "blue", "green"))
    df = spark.createDataFrame([(1, a), (2, a), (1, b), (3, b), (4, c), (4, c), (None, c), (None, "lone"), (None, "lone")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (4, c), (None, "lone")], key=str)


def test_keep_one_is_repeatable(spark):
    """Rows of one id and fingerprint that differ in other columns: the same ones stay on any partitioning, in any order."""
    a = " ".join(f"red{k}" for k in range(60))
    rows = [(1, a, la, s) for la, s in [("en", "x"), ("de", "y"), ("fr", "z")]] + [(None, a[::-1], la, "x") for la in ("en", "de")] + [(2, a, "en", "x")]
    found = set()
    for k, order in ((1, rows), (3, rows[::-1]), (6, rows)):
        found.add(tuple(sorted(map(tuple, simhash.keep_one(table(spark, order).repartition(k)).collect()), key=repr)))
    assert len(found) == 1 and len(found.pop()) == 2


@pytest.mark.parametrize("how", [{}, {"max_homes": 3, "max_members": 5}, {"max_members": 2, "max_hot_rows": 0}, {"views": simhash._views(4, 5, 2)}, {"views": simhash._views(4, 6, 3), "max_homes": 2}])
def test_links_join_all_close_fingerprints(spark, how):
    """Chains and dense clusters of random fingerprints, with anchors dealt to grids of tasks and views of all widths."""
    r = random.Random(1)
    fps = set()
    for _ in range(30):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 3, 40])):
            fps.add(x)
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    from trialweave.llm.components import connected_components

    found = {x.node: x.root for x in connected_components(simhash.links(df, **how)).collect()}
    group = {f: {f} for f in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 4 and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[a]:
                    group[x] = group[a]
    names = dict(zip(fps, signed, strict=True))
    for f in fps:
        assert found.get(names[f], names[f]) == min(names[x] for x in group[f])


@pytest.mark.parametrize("how", [{}, {"hub_rows": 0, "max_hubs": 10**9}, {"hub_rows": 3}, {"hub_rows": 1, "max_hubs": 40}])
def test_components_with_hubs(spark, how):
    """Stars whose middle is the least, the greatest or some node, a path, a random graph, loops, nulls and repeated edges."""
    from trialweave.llm.components import connected_components

    r = random.Random(6)
    edges = [(0, k) for k in range(1, 60)] + [(199, k) for k in range(100, 199)] + [(250, k) for k in range(200, 300)]
    edges += [(k, k + 1) for k in range(300, 330)] + [(r.randrange(400, 500), r.randrange(400, 500)) for _ in range(70)]
    edges += [(-7, 59), (7, 7), (None, 8), (600, None), (601, 601)] + r.sample(edges, 50)
    r.shuffle(edges)
    df = spark.createDataFrame([e if r.random() < 0.5 else e[::-1] for e in edges], "a long, b long").repartition(3)
    root = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root.setdefault(a, {a}), root.setdefault(b, {b})
            if x is not y:
                x |= y
                for k in y:
                    root[k] = x
    found = connected_components(df, **how).collect()
    assert sorted((x.node, x.root) for x in found) == sorted((k, min(group)) for k, group in root.items())


def test_quality_counts(docs, rows):
    found = quality_rules.quality_rules(docs)
    assert found.columns == ["doc_id", *quality_rules.COUNTS, "base_failed", "kept"]
    want = []
    for d, t in pairs(rows):
        c = brute.counts(t)
        want.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert plain(found.drop("kept")) == sorted(want, key=repr)
    assert found.where("kept and base_failed").count() == 0
    assert plain(quality_rules.keep_good(docs).select("doc_id")) == plain(found.where("kept").select("doc_id"))


def test_quality_fences_reject_what_stands_out(spark):
    r = random.Random(2)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(80))
    rows = [(k, prose(), "en", "a") for k in range(60)]
    rows += [(100, " ".join("w" + x + "***" for x in prose().split()), "en", "a"), (101, " ".join(x * 9 for x in prose().split()), "en", "a")]
    verdict = {x.doc_id: x.kept for x in quality_rules.quality_rules(table(spark, rows)).collect()}
    assert not verdict[100] and not verdict[101] and all(verdict[k] for k in range(60))


def test_line_dedup(spark):
    rows = [(k, f"menu\nline {k}\nmenu\n\nend", "en", "s1" if k < 20 else None) for k in range(40)]
    rows += [(50, "menu", "en", "s2"), (51, None, "en", "s1"), (52, "menu", "en", "s1"), (53, "rare\nmenu", "en", "s1"), (54, "", "en", "s1")]
    found = {x.doc_id: (x.text, x.n_lines, x.n_dropped) for x in line_dedup.drop_boilerplate(table(spark, rows)).collect()}
    assert found[3] == ("line 3\n", 5, 3)
    assert found[30] == ("line 30\n", 5, 3)  # null is a site too
    assert found[50] == ("menu", 1, 0)  # too few pages
    assert found[51] == (None, 0, 0) and found[52] == ("", 1, 1) and found[53] == ("rare", 2, 1) and found[54] == ("", 1, 0)
    assert line_dedup.drop_boilerplate(table(spark, rows)).columns[:7] == table(spark, rows).columns


def test_line_dedup_of_pages_of_much_boilerplate(spark):
    """Thousands of lines that go, repeated and in any order, among lines that stay and sort between them."""
    r = random.Random(8)
    menu = [f"menu {k}" for k in range(8000)]
    rows = []
    for k in range(6):
        lines = r.sample(menu, 7990) + menu[:5] * 2 + [f"menu {j} of {k}" for j in range(500)] + ["", " "]
        r.shuffle(lines)
        rows.append((k, "\n".join(lines), "en", "a"))
    having = defaultdict(int)
    for row in rows:
        for line in set(row[1].split("\n")):
            having[line] += 1
    want = [(d, "\n".join(x for x in t.split("\n") if having[x] < 2 or not x.strip())) for d, t, *_ in rows]
    assert plain(line_dedup.drop_boilerplate(table(spark, rows)).select("doc_id", "text")) == sorted(want, key=repr)


@pytest.mark.parametrize("max_keys", [0, 500_000])
def test_line_dedup_equals_plain_version(spark, max_keys):
    """Many hosts and lines, a hot host, long pages of boilerplate, and columns that clash with the new ones."""
    r = random.Random(5)
    menus = {h: [f"{h} menu {k}" for k in range(r.choice([1, 40]))] for h in "abcdefgh"}
    rows = []
    for k in range(500):
        host = r.choice("aaaabcdefgh")
        lines = [f"line {k} {j}" for j in range(r.randint(0, 6))] + r.sample(menus[host], r.randint(0, len(menus[host])))
        r.shuffle(lines)
        rows.append((k, "\n".join(lines), host))
    rows += [(900, "\n".join(menus["b"] * 200), "b"), (901, None, "b"), (902, "a menu 0", None)]
    df = spark.createDataFrame([(d, t, h, "old", -1, "x") for d, t, h in rows], "doc_id long, text string, source string, n_lines string, n_dropped int, `keys` string").repartition(5)
    found = line_dedup.drop_boilerplate(df, max_keys=max_keys, salt_pages=20)
    assert found.columns == ["doc_id", "text", "source", "keys", "n_lines", "n_dropped"]
    pages, having = defaultdict(int), defaultdict(int)
    for _, t, h in rows:
        pages[h] += 1
        for line in set((t or "").split("\n")):
            having[h, line] += 1
    gone = {(h, x) for (h, x), n in having.items() if n >= 2 and n > 0.05 * pages[h] and x.strip()}
    want = []
    for d, t, h in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if (h, x) not in gone]
        want.append((d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert plain(found.select("doc_id", "text", "n_lines", "n_dropped")) == sorted(want, key=repr)


def test_line_dedup_of_small_hosts(spark):
    """Fifty hosts of four pages that share two lines each: the ratio decides, and all of them go."""
    rows = [(4 * h + k, f"top of h{h}\nown {h} {k}\nend of h{h}", "en", f"h{h}") for h in range(50) for k in range(4)]
    found = line_dedup.drop_boilerplate(table(spark, rows)).collect()
    assert sum(x.n_dropped for x in found) == 400 and all(x.text == f"own {x.doc_id // 4} {x.doc_id % 4}" for x in found)


def test_quality_fences_by_sketches(spark):
    """A group of 200,000 rows: the sketch's quartiles lie within its rank error, and fences that are not broadcast judge alike."""
    rows = spark.range(200_000).select(F.lit("en").alias("lang"), F.lit("a").alias("source"), *[((F.col("id") * 7919 % 200_000) / 1000.0).cast("float").alias(x) for x in quality_rules.RATIOS])
    found = quality_rules.fences(rows, spread=3.0).first()["fences"]
    # quartiles of 0..200 are 50 and 150; a rank error of 1 / 2000 moves each by 0.1, the fences by 0.7
    assert found["symbols_high"] == pytest.approx(150 + 300, abs=0.7) and found["mean_word_low"] == pytest.approx(50 - 300, abs=0.7)


def test_quality_rules_beyond_the_broadcast_bound(spark, docs):
    assert plain(quality_rules.quality_rules(docs, max_bytes=0)) == plain(quality_rules.quality_rules(docs))
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(0)).withColumn("fences", F.lit(1))
    assert quality_rules.keep_good(clash).columns == clash.columns and plain(quality_rules.keep_good(clash).select("doc_id")) == plain(quality_rules.keep_good(docs).select("doc_id"))


def test_mixing(spark, docs, rows):
    found = [x.asDict() for x in mixing.mix(docs).collect()]
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(brute.words(t))
    want = brute.water(sizes)
    source = {(d, len(brute.words(t))): s for d, t, _, s in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for x in found:
        s = source[x["doc_id"], x["size"]]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(want[s]) and 0 <= x["taken"] <= 2 * x["size"] and x["taken"] == x["copies"] * x["size"]
        taken[s] += x["taken"]
        largest[s] = max(largest[s], x["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]
    again = mixing.mix(docs.repartition(3))
    assert plain(again) == sorted([tuple(x.values()) for x in found], key=repr)
    copies = mixing.mixed(docs.dropDuplicates(["doc_id"]))
    assert copies.columns == docs.columns and copies.count() > 0


def test_targets_share_the_excess(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 20, "d": 5, None: 7}, {"a": 1}, {"a": 0, "b": 3}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {x.source: x.target for x in mixing.targets(df).collect()}
        assert found == pytest.approx(brute.water(sizes))


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    extra = docs.sparkSession.createDataFrame([(500, "odd <|endoftext|> ​ 　  \x1c\x85 it's IT'S \U0001f600 ́ ١٢ x" + " " * 30 + "\n\n"), (501, "a" * 3000)], "doc_id long, text string")
    everything = docs.select("doc_id", "text").unionByName(extra)
    found = packing.pack(everything, tokenizer_path()).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in found:
        sequences[x.sequence_id].append((x.offset, x.length))
        pieces[x.doc_id].append(x)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    want = defaultdict(list)
    for d, t in [(x.doc_id, x.text) for x in everything.collect()]:
        want[d].append([*reference.encode(t or "", add_special_tokens=False).ids, 1])
    import numpy as np

    for d, texts in want.items():
        assert sum(p.length for p in pieces[d]) == sum(map(len, texts))
        for p in pieces[d]:
            assert any(p.doc_tokens == len(i) and p.ids_crc32 == zlib.crc32(np.array(i[p.start : p.start + p.length], "<u4").tobytes()) for i in texts)
    padding = sum(2048 - n for n in (sum(x for _, x in p) for p in sequences.values()) if n & (n - 1))
    assert padding == 0


def test_packing_looks_at_every_sequence():
    """Forty cheaper sequences are too full for the pieces of 33; the five dear ones hold them whole."""
    import numpy as np

    packer = packing.Packer(0, 100, 1.0, 1.0)
    lengths = [60] * 5 + [35] * 80 + [33] * 5 + [30] * 40 + [7] * 5
    left = packer.pack([(k, np.zeros(n, np.uint32), 0, n) for k, n in enumerate(lengths)], last=False)
    assert not left and sorted((r[0], r[2]) for r in packer.rows) == list(enumerate(lengths))


def test_packing_balances_cost():
    import numpy as np

    packer = packing.Packer(0, 100, 1.0, 1.0)
    left = packer.pack([(k, np.zeros(n, np.uint32), 0, n) for k, n in enumerate([90, 60, 40, 50, 30, 30])], last=False)
    assert not left and sorted({r[5] for r in packer.rows}) == [0, 1, 2]
    assert all(sum(r[2] for r in packer.rows if r[5] == s) == 100 for s in range(3))


def test_empty_tables(spark):
    empty = table(spark, [])
    assert substring.remove_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert line_dedup.drop_boilerplate(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0
