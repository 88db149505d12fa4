"""Exact removal of repeated passages, with a count-min prefilter.

A window is ``width`` consecutive words of a document.  Documents are dealt at
random into chunks of a few MB; the deal is written down once, in the shared
folder, since three passes over the chunks have to agree on it, on any input
and after the loss of any executor:

1. Each chunk's count-min sketch: the cells that its windows' hashes hit, in
   ``depth`` rows, saturating at two.  A chunk hits few of a row's cells, so a
   sketch travels as sorted cells, cut into shards of the row.  Adding up the
   chunks' sketches shard by shard gives counts that are never too low; each
   chunk gets back which of its cells reach two.
2. Windows whose cells all reach two are estimated repeated.  Only their
   128-bit fingerprints travel, sorted and sharded in the same way, and are
   grouped exactly; each chunk gets back which of its fingerprints repeat.
3. Words under a repeated window are cut.

The sketch has ``cells_per_byte`` cells for each byte of text and row, so its
error does not grow with the input, and a shard of it is of fixed size: no task
holds, and nothing broadcasts, the whole.  A window that repeats in many chunks
costs one cell and one fingerprint per chunk, however frequent it is.

Grouping is exact on fingerprints: two windows count as equal if two 64-bit
polynomials over two hashes of their words both agree.  Words of up to seven
bytes have hashes of their own, longer ones the halves of their XXH3-128.
Windows themselves are not shipped and compared, which would move each text
``width`` times over.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .hashing import pieces, scramble, word_digests

_WORD_A, _WORD_B = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))  # odd multipliers
#: Cells of a shard, as a power of two.  A chunk sends each shard one row, so that shards have to be large enough for
#: a chunk to have many cells in each: a chunk of 6 MB has a million windows.
_SHARD_BITS = 25
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0..n-1 and their inverses, modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        size = 1 << max(16, int(n - 1).bit_length())
        have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, inverse))
        _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def window_hashes(words: np.ndarray, width: int, base: np.uint64, salt: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` of the hashed ``words``."""
    up, down = _powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return scramble((sums[width:] - sums[:-width]) * down[: len(words) + 1 - width], salt)


# --- sorted numbers as bytes ------------------------------------------------


def shrink(values: np.ndarray) -> bytes:
    """Sorted distinct numbers below 2 ** 32: their differences by byte plane, low bytes as they are."""
    steps = np.diff(values.astype(np.uint32), prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    high = zlib.compress(np.ascontiguousarray(steps[:, 1:].T).tobytes(), 1)
    return len(values).to_bytes(4, "little") + np.ascontiguousarray(steps[:, 0]).tobytes() + high


def grow(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    steps = np.zeros((n, 4), np.uint8)
    steps[:, 0] = np.frombuffer(blob, np.uint8, n, 4)
    steps[:, 1:] = np.frombuffer(zlib.decompress(blob[4 + n :]), np.uint8).reshape(3, n).T
    return np.cumsum(steps.view("<u4")[:, 0], dtype=np.int64)


def bits_in(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def bits_out(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8), count=n).astype(bool)


# --- chunks -----------------------------------------------------------------


@dataclass
class Chunk:
    """The windows of a chunk's documents, and where they start."""

    n_words: np.ndarray
    hash_a: np.ndarray
    hash_b: np.ndarray
    place: np.ndarray  # of each window's first word among the chunk's words

    @classmethod
    def of(cls, texts: pa.ChunkedArray, width: int, both: bool) -> Chunk:
        n_words, one, two = word_digests(texts)
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(n_words)])[:-1]
        n_windows = np.maximum(n_words - width + 1, 0)
        place = np.repeat(starts - np.concatenate([[0], np.cumsum(n_windows)])[:-1], n_windows) + np.arange(n_windows.sum())
        if not len(place):
            return cls(n_words, np.zeros(0, np.uint64), np.zeros(0, np.uint64), place)
        a = window_hashes(one, width, _WORD_A, 12)[place]
        b = window_hashes(two, width, _WORD_B, 24)[place] if both else a
        return cls(n_words, a, b, place)


def _cells(hash_a: np.ndarray, row: int, bits: int) -> np.ndarray:
    return scramble(hash_a, 101 + row) >> np.uint64(64 - bits)


def _sliced(sorted_values: np.ndarray, shift: int) -> list[tuple[int, slice]]:
    """(shard, where) of sorted numbers whose high bits name the shard."""
    shards = sorted_values >> np.uint64(shift)
    cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]]) if len(shards) else [0]
    return [(int(shards[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_BLOBS = pa.schema([("row", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary()), ("twice", pa.binary())])
_BLOBS_SQL = "row int, shard long, chunk long, blob binary, twice binary"
_FLAGS = pa.schema([("chunk", pa.int64()), ("row", pa.int32()), ("shard", pa.int64()), ("flags", pa.binary())])
_FLAGS_SQL = "chunk long, row int, shard long, flags binary"
_EXACT = -1  # the row number of exact fingerprints


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)


def _sketch(docs: pa.Table, width: int, depth: int, bits: int) -> pa.Table:
    """Pass 1: a chunk's count-min sketch."""
    chunk, rows = docs["chunk"][0].as_py(), []
    windows = Chunk.of(docs["raw"], width, both=False)
    for row in range(depth):
        cells, counts = np.unique(_cells(windows.hash_a, row, bits), return_counts=True)
        for shard, where in _sliced(cells, _SHARD_BITS):
            local = cells[where] & np.uint64((1 << _SHARD_BITS) - 1)
            rows.append((row, shard, chunk, shrink(local), bits_in(counts[where] > 1)))
    return _table(rows, _BLOBS)


def _merge_sketches(blobs: pa.Table) -> pa.Table:
    """One shard of one row: add up the chunks' counts, and tell each chunk which of its cells reach two."""
    row, shard = blobs["row"][0].as_py(), blobs["shard"][0].as_py()
    counts = np.zeros(1 << _SHARD_BITS, np.uint8)
    for blob, twice in zip(blobs["blob"], blobs["twice"], strict=True):
        cells = grow(blob.as_py())
        counts[cells] = np.minimum(counts[cells] + np.uint8(1) + bits_out(twice.as_py(), len(cells)), 2)
    rows = [(c.as_py(), row, shard, bits_in(counts[grow(b.as_py())] > 1)) for c, b in zip(blobs["chunk"], blobs["blob"], strict=True)]
    return _table(rows, _FLAGS)


def _estimated(windows: Chunk, flags: pa.Table, depth: int, bits: int) -> np.ndarray:
    """Indexes of the windows that the merged sketch gives two or more."""
    likely = np.ones(len(windows.hash_a), bool)
    told = {(r, s): f for r, s, f in zip(flags["row"].to_pylist(), flags["shard"].to_pylist(), flags["flags"].to_pylist(), strict=True)}
    for row in range(depth):
        cells, back = np.unique(_cells(windows.hash_a, row, bits), return_inverse=True)
        reached = np.zeros(len(cells), bool)
        for shard, where in _sliced(cells, _SHARD_BITS):
            reached[where] = bits_out(told[row, shard], where.stop - where.start)
        likely &= reached[back]
    return np.flatnonzero(likely)


def _keys(windows: Chunk, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct 128-bit fingerprints of the windows at ``at``, their counts, and each window's place among them."""
    pairs = np.empty(len(at), [("a", "<u8"), ("b", "<u8")])
    pairs["a"], pairs["b"] = windows.hash_a[at], windows.hash_b[at]
    order = np.lexsort((pairs["b"], pairs["a"]))
    ordered = pairs[order]
    new = np.ones(len(at), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(at), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], np.bincount(back, minlength=int(new.sum())), back


def _candidates(docs: pa.Table, flags: pa.Table, width: int, depth: int, bits: int) -> pa.Table:
    """Pass 2: fingerprints of the windows estimated repeated."""
    if not docs.num_rows:
        return _table([], _BLOBS)
    windows, rows = Chunk.of(docs["raw"], width, both=True), []
    keys, counts, _ = _keys(windows, _estimated(windows, flags, depth, bits))
    for shard, where in _sliced(np.ascontiguousarray(keys["a"]), 64 - (bits - _SHARD_BITS)) if bits > _SHARD_BITS else [(0, slice(0, len(keys)))] * bool(len(keys)):
        rows.append((_EXACT, shard, docs["chunk"][0].as_py(), keys[where].tobytes(), bits_in(counts[where] > 1)))
    return _table(rows, _BLOBS)


def _group_exactly(blobs: pa.Table) -> pa.Table:
    """One shard of fingerprints: which of them occur twice or more, told to each chunk that has them."""
    shard, parts = blobs["shard"][0].as_py(), [np.frombuffer(b.as_py(), [("a", "<u8"), ("b", "<u8")]) for b in blobs["blob"]]
    everything = np.concatenate(parts)
    twice = np.concatenate([bits_out(t.as_py(), len(p)) for t, p in zip(blobs["twice"], parts, strict=True)])
    order = np.lexsort((everything["b"], everything["a"]))
    ordered = everything[order]
    equal = ordered[1:] == ordered[:-1]
    repeated = np.empty(len(order), bool)
    repeated[order] = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    repeated |= twice
    cuts = np.cumsum([0, *map(len, parts)])
    return _table([(c.as_py(), _EXACT, shard, bits_in(repeated[a:b])) for c, a, b in zip(blobs["chunk"], cuts, cuts[1:], strict=False)], _FLAGS)


def _cut(docs: pa.Table, flags: pa.Table, width: int, depth: int, bits: int) -> tuple[Chunk, np.ndarray]:
    """Pass 3: a chunk, and for each of its words whether a repeated window covers it."""
    windows = Chunk.of(docs["raw"], width, both=True)
    at = _estimated(windows, flags, depth, bits)
    keys, _, back = _keys(windows, at)
    exact = {s: f for r, s, f in zip(flags["row"].to_pylist(), flags["shard"].to_pylist(), flags["flags"].to_pylist(), strict=True) if r == _EXACT}
    repeated = np.zeros(len(keys), bool)
    for shard, where in _sliced(np.ascontiguousarray(keys["a"]), 64 - (bits - _SHARD_BITS)) if bits > _SHARD_BITS else [(0, slice(0, len(keys)))] * bool(len(keys)):
        repeated[where] = bits_out(exact[shard], where.stop - where.start)
    first = windows.place[at[repeated[back]]]
    covered = np.zeros(int(windows.n_words.sum()) + 1, np.int64)
    np.add.at(covered, first, 1)
    np.add.at(covered, first + width, -1)
    return windows, np.cumsum(covered)[:-1] > 0


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])
_RESULT_SQL = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def kept_words(raw: bytes, gone: np.ndarray) -> bytes:
    """The words of ``raw`` that are not ``gone``, joined by one space."""
    out, at = [], 0
    for words in pieces(raw):
        here = gone[at : at + len(words)]
        at += len(words)
        if here.any():
            words = [words[k] for k in np.flatnonzero(~here)]
        if words:
            out.append(b" ".join(words))
    return b" ".join(out)


def _result(docs: pa.Table, flags: pa.Table, width: int, depth: int, bits: int, with_text: bool) -> pa.Table:
    if not docs.num_rows:
        return _table([], _RESULT)
    windows, covered = _cut(docs, flags, width, depth, bits)
    rows, start = [], 0
    for doc_id, raw, n in zip(docs["doc_id"].to_pylist(), docs["raw"], windows.n_words.tolist(), strict=True):
        gone = covered[start : start + n]
        start += n
        flat = kept_words(raw.as_py() or b"", gone)
        rows.append((doc_id, n, int(gone.sum()), flat.decode("utf-8", "replace") if with_text else None, hashlib.sha256(flat).hexdigest()))
    return _table(rows, _RESULT)


def remove_repeats(docs: DataFrame, *, width: int = 35, depth: int = 2, cells_per_byte: float = 1.6, chunk_bytes: int = 6 << 20, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 for every row of ``docs`` (``doc_id``, ``text``).

    Words are runs of anything but ASCII white space.  A word goes if a window
    of ``width`` words over it has the same words as a window that starts
    anywhere else, in the same document too; windows are those of the input.
    ``kept_text`` (null unless ``with_text``) is the kept words joined by one
    space, ``kept_sha256`` its hash.  A null text is one without words; a text
    shorter than a window is kept whole; a repeated row repeats its windows; an
    empty table gives no rows; other columns are ignored.
    """
    # rows are dealt by place, not by value, so that equal rows spread as well; a place is only good once it is written
    # down, since rows of a shuffled input may come in another order when they are made again
    spread = F.xxhash64(F.monotonically_increasing_id())
    rows = docs.select(spread.alias("spread"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), F.octet_length("text").alias("bytes"))
    rows = stored(rows, compression="zstd")
    n_bytes = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = max(_SHARD_BITS, int(n_bytes * cells_per_byte).bit_length())
    by_chunk = rows.select(F.pmod("spread", F.lit(1 + n_bytes // chunk_bytes)).alias("chunk"), "doc_id", "raw").groupBy("chunk")
    sketches = by_chunk.applyInArrow(lambda t: _sketch(t, width, depth, bits), _BLOBS_SQL)
    reached = sketches.groupBy("row", "shard").applyInArrow(_merge_sketches, _FLAGS_SQL)
    found = by_chunk.cogroup(reached.groupBy("chunk")).applyInArrow(lambda d, f: _candidates(d, f, width, depth, bits), _BLOBS_SQL)
    exact = found.groupBy("row", "shard").applyInArrow(_group_exactly, _FLAGS_SQL)
    flags = reached.unionByName(exact)
    return by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(lambda d, f: _result(d, f, width, depth, bits, with_text), _RESULT_SQL)
