"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Every document is tokenised, ended by ``eos_id`` and cut into pieces; a piece
of full length is a sequence of its own.  The rest are spread by cost:
attention over a piece of n tokens costs about ``linear * n + quadratic * n**2``,
and the pieces, in descending cost, go to the sequence of lowest cost so far
that has room.  What fits nowhere is cut at the room of the cheapest sequence,
so that every sequence but a task's last is full.

Packing is local to a task: nothing is shuffled, a lost executor costs only
its own tasks, and a sequence id is (partition << 40) + number.  Within a task
documents are packed in groups of about ``group_tokens`` tokens, and the few
tokens left over join the next group, so memory does not grow with the input.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern of the byte-level BPE vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(tokenizer_path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids, equal to those of ``tokenizers`` for a byte-level BPE file without special tokens added.

    A byte-level BPE vocabulary whose ids follow its merges runs on the faster
    of the two public libraries; anything else, texts of over a million
    characters, texts that hold a special token's string, and any text on which
    that library fails, go through ``tokenizers`` itself.  The ids are the same.
    """
    if tokenizer_path in _ENCODERS:
        return _ENCODERS[tokenizer_path]
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        spec = json.load(file)
    plain = Tokenizer.from_file(tokenizer_path)

    def slow(text: str) -> np.ndarray:
        return np.asarray(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    encode = slow
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        import tiktoken

        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            # special strings are found in plain text, as the other library does by default
            if len(text) > 1_000_000 or any(s in text for s in special):
                return slow(text)
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the library's panics do not derive from Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                return slow(text)

    _ENCODERS[tokenizer_path] = encode
    return encode


class Packer:
    """Packs the pieces of one task; see the module's text."""

    def __init__(self, first_id: int, capacity: int, linear: float, quadratic: float):
        self.next_id, self.capacity, self.linear, self.quadratic = first_id, capacity, linear, quadratic
        self.rows: list[tuple] = []

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def _put(self, piece: tuple, at: int, length: int, sequence: int, offset: int) -> None:
        doc_id, ids, start = piece[:3]
        crc = zlib.crc32(ids[at : at + length].tobytes()) if length else 0
        self.rows.append((doc_id, start + at, length, crc, piece[3], sequence, offset))

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def pack(self, pieces: list[tuple], last: bool) -> list[tuple]:
        """Place ``pieces`` (doc_id, ids, start, doc_tokens), each shorter than a sequence; give back what is left over.

        With ``last`` nothing is left over: the tail goes into sequences whose
        lengths are powers of two, which need no padding.
        """
        total = sum(len(p[1]) for p in pieces)
        rooms = [self.capacity] * (total // self.capacity)
        if last and (tail := total % self.capacity):
            rooms += [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
        pieces = sorted(pieces, key=lambda p: -len(p[1]))
        if not rooms:
            return pieces
        ids = [self.new_id() for _ in rooms]
        room, cost, offset = np.array(rooms), np.zeros(len(rooms)), [0] * len(rooms)
        n_open = len(rooms)  # a full sequence costs infinitely much
        left: list[tuple] = []
        for piece in pieces:
            at, n = 0, len(piece[1])
            while at < n and n_open:
                # the cheapest of all sequences with room for the whole of it; if there is none, cut at the cheapest
                k = int(np.where(room >= n - at, cost, np.inf).argmin())
                if room[k] < n - at:
                    k = int(cost.argmin())
                take = min(int(room[k]), n - at)
                self._put(piece, at, take, ids[k], offset[k])
                at, offset[k] = at + take, offset[k] + take
                room[k] -= take
                cost[k] += self.cost(take)
                if not room[k]:
                    cost[k], n_open = np.inf, n_open - 1
            if at < n:
                left.append((piece[0], piece[1][at:], piece[2] + at, piece[3]))
        return left


def _pack_task(batches: Iterator[pa.RecordBatch], path: str, eos_id: int, capacity: int, linear: float, quadratic: float, group_tokens: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(SparkFiles.get(path))
    packer = Packer(TaskContext.get().partitionId() << 40, capacity, linear, quadratic)
    names = [f.split()[0] for f in _SCHEMA.split(", ")]

    def out() -> pa.RecordBatch:
        rows, packer.rows = packer.rows, []
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    waiting: list[tuple] = []
    tokens = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(text.as_py() or ""), np.uint32(eos_id)).astype("<u4")
            n = len(ids)
            for start in range(0, n - capacity + 1, capacity):
                packer._put((doc_id, ids, 0, n), start, capacity, packer.new_id(), 0)
            if n % capacity:
                start = n - n % capacity
                waiting.append((doc_id, ids[start:], start, n))
                tokens += n - start
            if tokens >= group_tokens:
                waiting = packer.pack(waiting, last=False)
                tokens = sum(len(p[1]) for p in waiting)
            if len(packer.rows) >= 20_000:
                yield out()
    packer.pack(waiting, last=True)
    yield out()


def pack(docs: DataFrame, tokenizer_path: str, *, eos_id: int = 1, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 4096, group_tokens: int = 1_000_000) -> DataFrame:
    """One row per piece of every document of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    A null text is packed as an empty one: its single token is ``eos_id``.
    Repeated rows and ids are packed once each; an empty table gives no rows.
    The tokenizer's file is read on the driver's side and sent to executors.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer_path)
    name = os.path.basename(tokenizer_path)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _pack_task(batches, name, eos_id, capacity, linear, quadratic, group_tokens), _SCHEMA
    )
