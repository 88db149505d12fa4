"""Words of whole texts, and hashes of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_PIECE = 1 << 20  # bytes of a text split at a time
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of UTF-8 ``raw`` (runs of anything but ASCII white space), in lists of bounded length unless a word is longer."""
    start = 0
    while start < len(raw):
        gap = _SPACE.search(raw, start + _PIECE) if len(raw) - start > _PIECE else None
        stop = gap.start() if gap else len(raw)
        if words := raw[start:stop].split():
            yield words
        start = stop


def scramble(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


class _Numbers(dict):
    """Word -> its number, in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_SHORT = 7  # bytes of a word that fits a 64-bit number beside its length
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(_SHORT + 1)], np.uint64)


def word_digests(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many words each of ``texts`` (binary; null: none) has, and two 64-bit hashes of every word, text by text.

    A word of up to seven bytes is a number of its own, and each hash a
    bijection of it: short words never collide.  Of a longer one the hashes are
    the halves of its XXH3-128.
    """
    column = texts.combine_chunks().fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = memoryview(column.buffers()[2] or b"")[bounds[0] : bounds[-1]].tobytes() + bytes(8)
    letters, bounds = np.frombuffer(raw, np.uint8)[:-8], bounds - bounds[0]
    blank = (letters == 32) | (letters - np.uint8(9) < 5)
    before, after = np.concatenate([[True], blank[:-1]])[: len(letters)], np.concatenate([blank[1:], [True]])[: len(letters)]
    filled = bounds[:-1] < bounds[1:]  # words end where texts do
    before[bounds[:-1][filled]], after[bounds[1:][filled] - 1] = True, True
    starts, stops = np.flatnonzero(before & ~blank), np.flatnonzero(after & ~blank) + 1
    n_words = np.diff(np.searchsorted(starts, bounds))
    sizes = stops - starts
    values = np.ndarray((len(letters) + 1,), "<u8", raw, strides=(1,))[starts] & _MASKS[np.minimum(sizes, _SHORT)] | sizes.astype(np.uint64) << np.uint64(8 * _SHORT)
    one, two = scramble(values, 0x9E3779B97F4A7C15), scramble(values, 0xD1B54A32D192ED03)
    long, numbers = np.flatnonzero(sizes > _SHORT), _Numbers()
    if len(long):
        which = np.fromiter((numbers[raw[a:b]] for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True)), np.int64, len(long))
        halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, numbers)), ">u8").reshape(-1, 2).astype(np.uint64)
        one[long], two[long] = halves[which, 0], halves[which, 1]
    return n_words, one, two


class _Cache(dict):
    """Word -> its 64-bit hash; forgets everything when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Cache()


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of ``raw``."""
    found = [np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words)) for words in pieces(raw)]
    return np.concatenate([np.zeros(0, np.uint64), *found])
