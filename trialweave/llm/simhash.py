"""SimHash near-duplicates by anchor-point covering.

A view is the bits of p out of m segments of the fingerprint, and there is one
for each choice of p.  Fingerprints at most t bits apart differ in at most one
bit in some view, if m and p are chosen for that (``best_views``).  On a view
the anchors are the words of the covering code Hamming x {0,1}^f, whose
covering radius is 1: the nearest anchor of x is at most 1 away, and so at most
2 (radius plus the view's threshold) from every y that is at most 1 from x.
Each distinct fingerprint is copied to all anchors within 2 bits, once as
"home" (its nearest anchor) and otherwise as visitor, and homes meet visitors
anchor by anchor.  Wider views have more anchors and cost more copies: the more
fingerprints there are, the wider the views, so that an anchor's group, and the
comparisons of a fingerprint, do not grow with their number.

An anchor's group gives a spanning forest, never its pairs; the forests' edges
are then joined into components by distributed star contraction.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, same, small_or_shuffled, told
from .components import connected_components

BITS = 64


# --- fingerprints -----------------------------------------------------------


def fingerprint(raw: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of UTF-8 text: bit i is set if it is set in over half of the shingles' XXH64."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    counts, n = np.zeros(BITS, np.int64), 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long: the 64 bits as a signed number) for every row of ``docs``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(task, "doc_id long, fp long")


# --- anchors ----------------------------------------------------------------


View = list[tuple[int, int]]  # (first bit, bits) of each of its segments


def _views(threshold: int, m: int, p: int) -> list[View] | None:
    """All choices of ``p`` of ``m`` segments; None if fingerprints ``threshold`` bits apart may differ in two bits in each of them."""
    each, rest = divmod(threshold, m)
    if p * each + max(0, p - (m - rest)) > 1:
        return None
    cuts = [BITS * k // m for k in range(m + 1)]
    segments = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [list(choice) for choice in itertools.combinations(segments, p)]


def _code_bits(bits: int) -> int:
    """The length of the longest Hamming code of 3, 7, 15 or 31 bits that fits."""
    return (1 << min(5, (bits + 1).bit_length() - 1)) - 1


def best_views(threshold: int, n: int) -> list[View]:
    """The views that make the least work of ``n`` fingerprints: copies to shuffle, and homes to compare each copy with."""
    found = []
    for m in range(threshold // 2 + 1, 9):
        for p in range(1, m):
            if views := _views(threshold, m, p):
                bits = sum(w for _, w in views[0])
                code = _code_bits(bits)
                free = bits - code
                copies = len(views) * (1 + free + free * (free - 1) / 2 / (code + 1) + (code - 1) / 2)
                found.append((copies * (300 + n * (code + 1) / 2.0**bits), m, views))  # moving a copy costs about 300 comparisons
    return min(found, key=lambda f: f[:2])[2] if found else [[(0, BITS)]]


def anchors_of(fps: np.ndarray, view: View, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fps, anchor, is home) for one view: all anchors within 2 bits of each fingerprint."""
    value, bits = np.zeros(len(fps), np.uint64), 0
    for first, width in view:
        value |= ((fps >> np.uint64(first)) & np.uint64((1 << width) - 1)) << np.uint64(bits)
        bits += width
    code_bits = _code_bits(bits)
    free_bits = bits - code_bits
    low, free = (value & np.uint64((1 << code_bits) - 1)).astype(np.int64), (value >> np.uint64(code_bits)).astype(np.int64)
    syndrome = np.zeros(len(fps), np.int64)
    for k in range(code_bits):
        syndrome ^= np.where(low >> k & 1, k + 1, 0)
    off = syndrome != 0
    nearest = np.where(off, low ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), low)
    at, codes, frees, homes = [], [], [], []
    everyone = np.arange(len(fps))

    def add(index: np.ndarray, code: np.ndarray, free_: np.ndarray, home: bool = False) -> None:
        at.append(index), codes.append(code), frees.append(free_), homes.append(np.full(len(index), home))

    add(everyone, nearest, free, True)
    exact = np.flatnonzero(~off)  # two more bits of room only where the code part fits exactly
    for i in range(free_bits):
        add(everyone, nearest, free ^ (1 << i))
        for j in range(i):
            add(exact, nearest[exact], free[exact] ^ (1 << i) ^ (1 << j))
    for i in range(1, code_bits + 1):  # the code words two bits away: flip i and j with i ^ j = syndrome
        two = np.flatnonzero(off & ((syndrome ^ i) > i))
        add(two, low[two] ^ (1 << (i - 1)) ^ (np.int64(1) << ((syndrome[two] ^ i) - 1)), free[two])
    anchor = (np.int64(number) << np.int64(56)) | (np.concatenate(frees) << np.int64(code_bits)) | np.concatenate(codes)
    return np.concatenate(at), anchor, np.concatenate(homes)


def _anchor_task(batches: Iterator[pa.RecordBatch], views: list[View]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        everything = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for start in range(0, len(everything), 4096):
            fps = everything[start : start + 4096]
            for k, view in enumerate(views):
                at, anchor, home = anchors_of(fps, view, k)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fps[at].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


# --- comparison -------------------------------------------------------------


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each node's component, by pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            break
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (jumped := root[root]).tobytes() != root.tobytes():
            root = jumped
    return root


def _forest_of_group(fps: np.ndarray, home: np.ndarray, threshold: int) -> np.ndarray:
    """For each member of one anchor's group, the index of its tree's root; compares homes with members block by block."""
    root = np.arange(len(fps))
    homes = np.flatnonzero(home)
    step = max(1, (1 << 20) // max(1, len(fps)))
    for start in range(0, len(homes), step):
        part = homes[start : start + step]
        i, j = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[None, :]) <= threshold)
        a, b = root[part[i]], root[j]
        if (differ := a != b).any():
            ends = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)])[:, differ], axis=1)
            root = _roots(len(fps), ends[0], ends[1])[root]
    return root


def _compare_task(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group; groups of a few members are compared together, larger ones alone."""

    def forest(group: np.ndarray, fps: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(fps)))
        root = np.arange(len(fps))
        small = np.repeat(sizes <= 64, sizes)
        end = np.repeat(starts + sizes, sizes)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        alive = np.flatnonzero(small)
        for k in range(1, 64):
            alive = alive[alive + k < end[alive]]
            if not len(alive):
                break
            close = alive[(np.bitwise_count(fps[alive] ^ fps[alive + k]) <= threshold) & (home[alive] | home[alive + k])]
            links.append((close, close + k))
        if links:
            root = _roots(len(fps), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
        for s, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
            root[s : s + n] = s + _forest_of_group(fps[s : s + n], home[s : s + n], threshold)
        linked = np.flatnonzero((root != np.arange(len(fps))) & (fps[root] != fps))
        a, b = fps[linked].view(np.int64), fps[root[linked]].view(np.int64)
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # the last group may go on in the next batch
    for batch in batches:
        group = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1)
        fps, home = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)
        if not len(fps):
            continue
        new = np.flatnonzero((group != group[-1]).any(axis=1))
        cut = new[-1] + 1 if len(new) else 0
        if held and (cut or (held[0][0][-1] != group[0]).any()):
            if not (held[0][0][-1] != group[0]).any():
                held.append((group[:cut], fps[:cut], home[:cut]))
                group, fps, home, cut = group[cut:], fps[cut:], home[cut:], 0
            yield forest(*map(np.concatenate, zip(*held, strict=True)))
            held = []
        if cut:
            yield forest(group[:cut], fps[:cut], home[:cut])
        held.append((group[cut:], fps[cut:], home[cut:]))
    if held:
        yield forest(*map(np.concatenate, zip(*held, strict=True)))


def links(fps: DataFrame, *, threshold: int = 4, views: list[View] | None = None, max_homes: int = 20_000, max_members: int = 200_000, max_hot_rows: int = 10_000) -> DataFrame:
    """Edges (a, b) that connect all distinct values of ``fps.fp`` at most ``threshold`` bits apart, directly or in steps.

    An anchor with over ``max_homes`` homes or ``max_members`` fingerprints is
    dealt to a grid of tasks: its homes are split by hash into the rows, its
    members into the columns, and each cell compares its own.
    """
    views = views or best_views(threshold, fps.count())
    anchors = fps.select("fp").mapInArrow(lambda b: _anchor_task(b, views), "anchor long, fp long, home boolean")
    sizes = anchors.groupBy(F.col("anchor").alias("hot_anchor")).agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("members"))
    cells = sizes.where((F.col("homes") > max_homes) | (F.col("members") > max_members) & (F.col("homes") > 0))
    cells = cells.select("hot_anchor", F.ceil(F.col("homes") / max_homes).cast("long").alias("rows"), F.ceil(F.col("members") / max_members).cast("long").alias("columns"))
    hot = small_or_shuffled(checkpoint(cells), max_hot_rows)
    parted = anchors.join(hot, F.col("anchor") == F.col("hot_anchor"), "left")
    cell = lambda part, home: F.struct(part.cast("long").alias("part"), home.alias("home"))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    my_row, my_column = F.pmod(F.xxhash64("fp"), F.col("rows")), F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("columns"))
    as_member = F.transform(up_to(F.col("rows")), lambda r: cell(r * F.col("columns") + my_column, F.lit(False)))
    as_home = F.transform(up_to(F.col("columns")), lambda c: cell(my_row * F.col("columns") + c, F.lit(True)))
    dealt = F.when(F.col("rows").isNull(), F.array(cell(F.lit(0), F.col("home")))).when(F.col("home"), F.concat(as_member, as_home)).otherwise(as_member)
    rows = parted.select("anchor", "fp", F.explode(dealt).alias("c")).select("anchor", "c.part", "fp", "c.home")
    rows = rows.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return rows.mapInArrow(lambda b: _compare_task(b, threshold), "a long, b long")


def _grouped(docs: DataFrame, width: int, seed: int, threshold: int) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``; ``root`` names the component by a fingerprint."""
    rows = checkpoint(fingerprints(docs, width=width, seed=seed))
    least = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = checkpoint(connected_components(links(least, threshold=threshold)))
    named = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = checkpoint(named.join(of_root, "root").select("fp", "root", "component_id", "n"))
    return told(rows, of_fp, ["fp"], "n").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, width: int = 4, seed: int = 42, threshold: int = 4) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: the least doc_id reachable over links) for every row of ``docs``.

    Fingerprints link at ``threshold`` or fewer differing bits.  Words are runs
    of anything but ASCII white space, A-Z lower-cased.  A text of fewer than
    ``width`` words has one shingle; a null or blank text has fingerprint zero,
    which links like any other.  A null id never names a component unless it is
    all that the component has.  Repeated rows come back as often as they came.
    An empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    rows = _grouped(docs, width, seed, threshold)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, width: int = 4, seed: int = 42, threshold: int = 4, max_ids: int = 1_000_000) -> DataFrame:
    """``docs`` without near-duplicates: of each component the document with the least id stays, once.

    Of rows that share the kept id within a component, one of the least
    fingerprint stays (of several the least by a hash of all its columns, on any
    partitioning); in other components they are documents of their own.
    Of a component without any id, one row of the least fingerprint stays.
    All columns pass through, whatever their names.

    Texts do not move where at most ``max_ids`` ids go (8 bytes each, broadcast);
    beyond, they are shuffled by id once.  Rows that share an id or have none
    are fingerprinted again, since their ids do not tell them apart.
    """
    groups = checkpoint(_grouped(docs, width, seed, threshold))
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    ids = checkpoint(ids.where("n > 1 or not stays").select(F.col("doc_id").alias("of"), F.col("n")))
    named = docs.join(small_or_shuffled(ids.select("of"), max_ids), docs["doc_id"] == F.col("of"), "left_anti").where(docs["doc_id"].isNotNull())
    shared = small_or_shuffled(ids.where("n > 1").select("of"), max_ids)
    mine = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = mine.groupBy("root").agg(F.min("doc_id").alias("kept_id"), F.min("fp").alias("fp")).drop("root")
    exact = chosen.join(shared, F.col("kept_id") == F.col("of"), "left_semi").unionByName(chosen.where("kept_id is null"))
    unsure = docs.join(shared, docs["doc_id"] == F.col("of"), "left_semi").unionByName(docs.where(docs["doc_id"].isNull()))
    return named.unionByName(_one_of_each(unsure, exact, width, seed))


def _one_of_each(docs: DataFrame, chosen: DataFrame, width: int, seed: int) -> DataFrame:
    """One row of ``docs`` for each (kept_id, fp) of ``chosen``."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.col("text").cast("binary").alias("raw"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["_doc", "fp"])

    marked = rows.mapInArrow(task, rows.drop("raw").schema.add("fp", "long"))
    marked = marked.withColumn("kept_id", F.col("_doc.doc_id").cast("long"))
    marked = marked.join(chosen, same(marked, chosen, ["kept_id", "fp"]), "left_semi")
    # of rows that differ elsewhere, the least by a hash of all columns: the same whatever the partitions
    one = marked.groupBy("kept_id", "fp").agg(F.min_by("_doc", F.sha2(F.to_json("_doc"), 256)).alias("_doc"))
    return one.select("_doc.*")
