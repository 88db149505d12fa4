"""Ranked lexical search over dual-sorted wavelet trees.

A shard is some documents of a task, numbered by ascending id.  The postings of
all terms lie one after another, each term's by falling impact, and a wavelet
tree (in its matrix layout) holds their document numbers.  A node of the tree
is a range of documents, and because the tree keeps the order of what it
splits, the first posting of a term within a node is the one of greatest
impact there: postings are sorted by impact and by document at once.

A query starts with its terms' ranges at the root.  The sum over terms of
weight times first impact bounds every document of a node.  Nodes are taken
best first, some at a time, and split until they are single documents, whose
bound is their score; a node that cannot reach the k-th place is left alone.
The place to reach is carried from shard to shard within a task.

Nothing but the best k of a task is shuffled.  Documents are read once for
terms and counts (the shared folder keeps the counts of the queries' terms),
and those counts once for the search.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Every byte as it stands in a term: letters in lower case, digits and all of 0x80 and above; blank otherwise.
_FOLDED = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 0x20 for c in range(256)).lower()
_PIECE = 1 << 20  # bytes of a text taken at a time


def term_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of UTF-8 ``raw``: runs of ASCII letters and digits and other characters, in lists of bounded length unless a term is longer."""
    start = 0
    while start < len(raw):
        stop = min(len(raw), start + _PIECE)
        part = raw[start:stop].translate(_FOLDED)
        if stop < len(raw):
            gap = part.rfind(b" ")
            while gap < 0 and stop < len(raw):  # a term longer than a piece
                more = raw[stop : stop + _PIECE].translate(_FOLDED)
                stop += len(more)
                gap = more.find(b" ")
                gap = len(part) + gap if gap >= 0 else -1
                part += more
            if gap >= 0:
                part, stop = part[:gap], start + gap + 1  # behind the blank
        if found := part.split():
            yield found
        start = stop


# --- the index of a shard -----------------------------------------------------


class Bits:
    """A bit vector that counts the zeros before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones)])[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class DualSorted:
    """Postings of many terms: by impact within a term, by document through the tree."""

    def __init__(self, term: np.ndarray, document: np.ndarray, impact: np.ndarray, n_documents: int):
        order = np.lexsort((document, -impact, term))
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(term))
        self.depth = max(1, int(n_documents - 1).bit_length())
        document, impact = document[order], impact[order].astype(np.int32)
        self.levels: list[tuple[Bits, int]] = []
        self.impacts = [impact]
        for level in range(self.depth):
            one = (document >> (self.depth - 1 - level) & 1).astype(bool)
            self.levels.append((Bits(one), int(len(one) - one.sum())))
            document, impact = (np.concatenate([x[~one], x[one]]) for x in (document, impact))
            self.impacts.append(impact)

    def ranges(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the postings of ``terms`` lie; an empty range for those that it does not have."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        have = self.terms[at] == terms
        return np.where(have, self.first[at], 0), np.where(have, self.last[at], 0)


@dataclass
class Query:
    terms: np.ndarray
    weights: np.ndarray


class Best:
    """The k best of what has been seen, by falling score and rising id (null ids last)."""

    def __init__(self, k: int):
        self.k, self.heap = k, []  # the worst first

    def add(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)

    def reachable(self, bounds: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which nodes may hold something better than the k-th: by bound, and at the same score by the least id."""
        if len(self.heap) < self.k:
            return bounds > 0
        score, has_id, minus = self.heap[0]
        same = known & (~np.bool_(has_id) | (ids < -minus))
        return (bounds > score) | ((bounds == score) & same)


def search_shard(index: DualSorted, ids: np.ndarray, known: np.ndarray, query: Query, best: Best, batch: int = 256) -> int:
    """Offer ``best`` every document of the shard that can be among the first; returns how many nodes were split.

    ``ids`` are the documents' ids in ascending order, those that are not ``known`` (null) last.
    """
    low, high = index.ranges(query.terms)
    there = low < high
    if not there.any():
        return 0
    weights = query.weights[there]
    low, high = low[there][None], high[there][None]
    # nodes wait by level, as each level has its own bits; a node is the number of its first document shifted down
    bound = (index.impacts[0][low[0]].astype(np.int64) * weights).sum(keepdims=True)
    waiting = {0: (np.zeros(1, np.int64), low, high, bound)}
    splits = 0
    while waiting:
        # the level that holds the best node, and the best nodes there
        level = max(waiting, key=lambda at: (int(waiting[at][3].max()), at))
        node, low, high, bound = waiting.pop(level)
        left = node << (index.depth - level)
        alive = best.reachable(bound, known[left], ids[left])
        if not alive.any():
            continue
        if not alive.all():
            node, low, high, bound, left = node[alive], low[alive], high[alive], bound[alive], left[alive]
        if level == index.depth:
            for at in np.lexsort((left, -bound)):
                best.add(int(bound[at]), int(ids[left[at]]) if known[left[at]] else None)
            continue
        if len(node) > batch:
            first = np.argpartition(-bound, batch)
            rest, first = first[batch:], first[:batch]
            waiting[level] = (node[rest], low[rest], high[rest], bound[rest])
            node, low, high = node[first], low[first], high[first]
        splits += len(node)
        bits, zeros = index.levels[level]
        a, b = bits.ones(low), bits.ones(high)
        low = np.concatenate([low - a, zeros + a])
        high = np.concatenate([high - b, zeros + b])
        node = np.concatenate([node * 2, node * 2 + 1])
        filled = low < high
        values = index.impacts[level + 1][np.where(filled, low, 0)].astype(np.int64)
        bound = (values * filled * weights).sum(axis=1)
        node_left = node << (index.depth - level - 1)
        alive = bound > 0
        alive[alive] &= best.reachable(bound[alive], known[node_left[alive]], ids[node_left[alive]])
        if alive.any():
            made = node[alive], low[alive], high[alive], bound[alive]
            have = waiting.get(level + 1)
            waiting[level + 1] = made if have is None else tuple(map(np.concatenate, zip(have, made, strict=True)))
    return splits


# --- passes ---------------------------------------------------------------------


def _counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and counts of those of ``vocabulary``, for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                n, found = 0, Counter()
                for part in term_lists(text.as_py() or b""):
                    n += len(part)
                    found.update(filter(number.__contains__, part))
                sizes.append(n)
                terms.append([number[w] for w in found])
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(task, "doc_id long, n long, terms array<int>, counts array<long>")


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term counts in a document before its weight: saturated frequency against the document's length, in whole numbers."""
    m = 50 + (50 * n * n_docs) // max(1, n_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _shards(batches: Iterator[pa.RecordBatch], shard_documents: int, shard_postings: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    postings = documents = 0
    for batch in batches:
        sizes = np.cumsum(pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            room = max(0, shard_postings - postings)
            base = sizes[start - 1] if start else 0
            stop = min(batch.num_rows, start + max(0, shard_documents - documents), int(np.searchsorted(sizes, base + room, "right")))
            if stop == start and held:
                yield pa.Table.from_batches(held)
                held, postings, documents = [], 0, 0
                continue
            stop = max(stop, start + 1)
            held.append(batch.slice(start, stop - start))
            postings, documents, start = postings + int(sizes[stop - 1] - base), documents + stop - start, stop
    if held:
        yield pa.Table.from_batches(held)


def _search_task(batches: Iterator[pa.RecordBatch], queries: list[Query], k: int, n_docs: int, n_terms: int, shard_documents: int, shard_postings: int) -> Iterator[pa.RecordBatch]:
    best = [Best(k) for _ in queries]
    for table in _shards(batches, shard_documents, shard_postings):
        table = table.sort_by([("doc_id", "ascending")])  # null ids come last
        sizes = pa.compute.list_value_length(table["terms"]).to_numpy()
        document = np.repeat(np.arange(len(table)), sizes)
        flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        impact = impacts(flat("counts"), table["n"].to_numpy()[document], n_docs, n_terms)
        if not len(document):
            continue
        index = DualSorted(flat("terms"), document, impact, len(table))
        known = table["doc_id"].is_valid().to_numpy()
        ids = table["doc_id"].fill_null(0).to_numpy()
        for query, found in zip(queries, best, strict=True):
            search_shard(index, ids, known, query, found)
    rows = [(q, -minus if has_id else None, score) for q, found in enumerate(best) for score, has_id, minus in found.heap]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["query", "doc_id", "score"])


def _query_terms(queries: DataFrame) -> DataFrame:
    """item_id and its distinct terms, for each distinct row of ``queries``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set().union(*term_lists(t.as_py() or b""))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("raw")).distinct()
    return rows.mapInArrow(task, "item_id long, terms array<binary>")


def search(docs: DataFrame, queries: DataFrame, *, k: int = 50, shard_documents: int = 4096, shard_postings: int = 1_000_000, block_terms: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``queries`` (``item_id``, ``text``) its ``k`` best of ``docs`` (``doc_id``, ``text``).

    Terms are runs of ASCII letters and digits and of characters above 0x7F, A-Z
    in lower case; an item's terms count once each.  With N documents that have
    a term, L terms in all, n terms in a document, df documents with the term
    and tf of it in the document, a term adds
    floor(1000 ln((2N + 2) / (2 df + 1))) * (10^9 tf div (1000 tf + 20 m)), where
    m = 50 + (50 n N div L).  Documents of score 0 are not returned.  Equal
    scores rank by ascending id, null ids last.

    A null or blank text has no terms: no such document is found, and such an
    item finds nothing.  Repeated documents are documents of their own;
    repeated rows of ``queries`` are one query, rows of one id and different
    texts are queries of their own.  Empty tables give no rows; other columns
    are ignored, whatever their names.

    Queries are taken in blocks of about ``block_terms`` terms (one block
    unless there are more), each a pass over ``docs``; the terms and weights of
    a block go to every task.  A shard has at most ``shard_documents``
    documents and, unless one document has more, ``shard_postings`` postings;
    its index takes about 60 bytes a posting.
    """
    spark = docs.sparkSession
    asked = stored(_query_terms(queries))
    n_blocks = 1 + (asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms
    out = None
    for block in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n_blocks)) == block).orderBy("item_id", "terms").collect()
        found = _block(docs, [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in rows], k, shard_documents, shard_postings)
        out = found if out is None else out.unionByName(found)
    discard(asked)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _block(docs: DataFrame, asked: list[tuple[int | None, list[bytes]]], k: int, shard_documents: int, shard_postings: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: at for at, w in enumerate(sorted({w for _, terms in asked for w in terms}))}
    counts = stored(_counts(docs, vocabulary))
    total = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # at most one row for each term of the block
    df = {r["term"]: r["df"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
    weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df.get(at, 0) + 1))) for at in range(len(vocabulary))], np.int64)
    numbers = [np.array([vocabulary[w] for w in terms], np.int64) for _, terms in asked]
    useful = [n[weight[n] > 0] if len(n) else n for n in numbers]
    shared = spark.sparkContext.broadcast([Query(n, weight[n]) for n in useful])
    n_docs, n_terms = int(total["docs"]), int(total["terms"])
    found = counts.where(F.size("terms") > 0).mapInArrow(lambda b: _search_task(b, shared.value, k, n_docs, n_terms, shard_documents, shard_postings), "query int, doc_id long, score long")
    # each task's best, then the best of some tasks at a time, then of all: no task gets a query's rows of all tasks
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    items = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(asked)], "query int, item_id long")
    return best.join(F.broadcast(items), "query").select("item_id", "rank", "doc_id", "score")
