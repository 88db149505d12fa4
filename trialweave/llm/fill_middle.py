"""Fill-in-the-middle: texts cut at token borders into prefix, middle and suffix, and put together in another order.

The kernel takes the UTF-8 buffer of many texts at once.  A table gives every
byte its class, a comparison of neighbouring bytes marks where tokens end, a
running sum that starts anew at each text counts them, and one ``searchsorted``
finds the cuts of all texts.  Python touches a text only to copy its three
pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of prefix, suffix and middle, as the contract writes them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_MARKED = np.zeros(256, bool)
_MARKED[[PREFIX[1], SUFFIX[1], MIDDLE[1]]] = True
_PIECE = 4 << 20  # bytes of text that the kernel takes at a time, unless one text is longer


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``texts`` (binary; null: none), one after another, and the border before, between and after them."""
    texts = texts.fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of ``texts`` that hold about ``_PIECE`` bytes."""
    _, bounds = _buffer(texts)
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _PIECE, "right")) - 1)
        yield first, stop - first
        first = stop


def marks(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every mark of three bytes that lies within one text."""
    at = np.flatnonzero((raw[:-2] == ord("<")) & _MARKED[raw[1:-1]] & (raw[2:] == ord(">"))) if len(raw) > 2 else np.zeros(0, np.int64)
    of = np.searchsorted(bounds, at, "right") - 1
    inside = at + 3 <= bounds[of + 1]
    return of[inside], at[inside]


def token_cuts(raw: np.ndarray, bounds: np.ndarray, draws: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many tokens each text has, and where in ``raw`` the first ``draw % (tokens + 1)`` of them end, for each of ``draws``.

    A token is white space with the word after it; white space that ends a text is one as well.
    """
    blank = _BLANK[raw]
    ends = np.empty(len(raw), bool)
    ends[:-1] = ~blank[:-1] & blank[1:]
    filled = bounds[:-1] < bounds[1:]
    ends[bounds[1:][filled] - 1] = True  # the last byte of a text ends a token, whatever follows in the buffer
    counted = np.concatenate([np.zeros(1, np.int32), np.cumsum(ends, dtype=np.int32)])
    before = counted[bounds[:-1]]  # what a text's own count starts from
    n = counted[bounds[1:]] - before
    cuts = []
    for draw in draws:
        taken = draw % (n + 1)
        cuts.append(np.where(taken > 0, np.searchsorted(counted, before + taken), bounds[:-1]))
    return n.astype(np.int64), cuts


def _characters(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Code points between ``start`` and ``stop``."""
    inner = np.flatnonzero((raw & 0xC0) == 0x80)
    return stop - start - (np.searchsorted(inner, stop) - np.searchsorted(inner, start))


def _joined(parts: list, per_text: int) -> pa.Array:
    """Texts of ``per_text`` pieces each, as an Arrow column."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)).reshape(-1, per_text).sum(axis=1)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds.astype("<i8").tobytes()), pa.py_buffer(b"".join(parts))])


def _text(parts: list, per_text: int) -> pa.Array:
    return _joined(parts, per_text).cast(pa.large_string()).cast(pa.string())


def rearranged(texts: pa.Array, draws: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns n, form, prefix_chars, middle_chars and output of ``texts`` (binary); ``draws`` are four numbers for each."""
    raw, bounds = _buffer(texts)
    n, (a, b) = token_cuts(raw, bounds, draws[:2])
    first, second = np.minimum(a, b), np.maximum(a, b)
    start, stop = bounds[:-1], bounds[1:]
    plain = (start == stop) | (draws[2] % 100 >= fim_percent)
    plain[marks(raw, bounds)[0]] = True
    spm = draws[3] % 100 < spm_percent
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    view, parts = memoryview(raw), []
    for kind, s, x, y, e in zip(form.tolist(), start.tolist(), first.tolist(), second.tolist(), stop.tolist(), strict=True):
        if kind == "plain":
            parts += (view[s:e], b"", b"", b"", b"", b"")
        elif kind == "spm":
            parts += (SUFFIX, view[y:e], PREFIX, view[s:x], MIDDLE, view[x:y])
        else:
            parts += (PREFIX, view[s:x], SUFFIX, view[y:e], MIDDLE, view[x:y])
    chars = [pa.array(_characters(raw, p, q), mask=plain) for p, q in ((start, first), (first, second))]
    return [pa.array(n), pa.array(form.tolist(), pa.string()), *chars, _text(parts, 6)]


def put_back(outputs: pa.Array, forms: list[str | None]) -> pa.Array:
    """The texts that ``outputs`` (binary) of these forms were made from."""
    raw, bounds = _buffer(outputs)
    of, at = marks(raw, bounds)
    known = np.array([f in ("psm", "spm") for f in forms], bool)
    mine = known[of]
    found = at[mine].reshape(-1, 3)  # a rearranged text has three marks: at its start and before its second and third piece
    where = iter(found.tolist())
    view, parts = memoryview(raw), []
    for form, s, e in zip(forms, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if form not in ("psm", "spm"):
            parts += (view[s:e], b"", b"")
            continue
        one, two, three = next(where)
        pieces = view[one + 3 : two], view[two + 3 : three], view[three + 3 : e]
        prefix, suffix = pieces[:2] if form == "psm" else pieces[1::-1]
        parts += (prefix, pieces[2], suffix)
    return _text(parts, 3)


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the SHA-256 of ``seed:doc_id``, as numbers; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, *, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs`` (``doc_id``, ``text``).

    A token is white space (0x20, 0x09 to 0x0D) with the word after it, or the
    white space that ends a text; ``n`` counts them.  Two draws from the id, each
    modulo n + 1, say after how many tokens prefix and middle end; ``form`` is
    ``plain`` for texts that are empty, hold a mark or are not drawn
    (``fim_percent``), else ``spm`` (``spm_percent`` of them) or ``psm``.
    ``prefix_chars`` and ``middle_chars`` count code points, null if plain.

    A null text is an empty one.  Draws depend on the id alone: repeated rows
    and equal ids are cut alike, rows of null id as those of an empty id.  An
    empty table gives no rows; other columns, whatever their names, are
    ignored.  Nothing is shuffled; the kernel holds about ten bytes for each
    byte of 4 MB of texts, or of the longest text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"), *[d.alias(f"d{k}") for k, d in enumerate(_draws(F.col("doc_id"), seed))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size in _slices(batch.column(1)):
                part = batch.slice(first, size)
                made = rearranged(part.column(1), [part.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)], fim_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(task, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(rows: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """``rows`` with the column ``restored``: the text that ``output`` of this ``form`` was made from.

    Outputs of any other form, and of null form, are their own texts; a null
    output is an empty one.  A column that is already named ``restored`` is
    replaced; all others pass through.
    """
    rows = rows.drop(restored)
    kept = rows.columns
    schema = rows.schema.add(restored, "string")
    asked = rows.select("*", F.col(output).cast("binary").alias("_raw"), F.col(form).cast("string").alias("_form"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(kept)
        for batch in batches:
            for first, size in _slices(batch.column(n)):
                part = batch.slice(first, size)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], put_back(part.column(n), part.column(n + 1).to_pylist())], [*kept, restored])

    return asked.mapInArrow(task, schema)
