"""Round trips and invariants of the operators' parts."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from trialweave.llm import hashing, packing, simhash, substring


@given(st.sets(st.integers(0, 2**32 - 1)))
def test_sorted_numbers_come_back(values):
    x = np.array(sorted(values), np.uint64)
    assert substring.grow(substring.shrink(x)).tolist() == x.tolist()


@given(st.lists(st.booleans()))
def test_flags_come_back(flags):
    assert substring.bits_out(substring.bits_in(np.array(flags, bool)), len(flags)).tolist() == flags


@given(st.lists(st.text("abé", min_size=1, max_size=4), max_size=30))
def test_equal_words_have_equal_hashes_wherever_they_stand(words):
    found = hashing.word_hashes(" ".join(words).encode())
    by_word = {}
    assert len(found) == len(words)
    for w, h in zip(words, found.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


@given(st.lists(st.one_of(st.none(), st.text("ab \n\t\x0b\x85é\0", max_size=40)), max_size=6), st.integers(1, 9))
def test_words_do_not_depend_on_texts_or_pieces(texts, size):
    raw = [None if t is None else t.encode() for t in texts]
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t or b"") for t in raw]
    n, one, two = hashing.word_digests(pa.chunked_array([pa.array(raw[:2], pa.binary()), pa.array(raw[2:], pa.binary())]).slice(0, len(raw)))
    assert n.tolist() == list(map(len, words)) and len(one) == len(two) == sum(map(len, words))
    flat = [w for x in words for w in x]
    assert len(set(zip(flat, one.tolist(), two.tolist(), strict=True))) == len(set(flat)) == len(set(one.tolist())) == len(set(two.tolist()))
    kept, hashing._PIECE = hashing._PIECE, size
    try:
        for t, x in zip(raw, words, strict=True):
            assert [w for some in hashing.pieces(t or b"") for w in some] == x
            assert substring.kept_words(t or b"", np.arange(len(x)) % 2 > 0) == b" ".join(x[::2])
    finally:
        hashing._PIECE = kept


def test_words_of_a_slice():
    column = pa.array([b"one", b"two words", None, b"eightlong x"], pa.binary())
    n, one, _ = hashing.word_digests(pa.chunked_array([column.slice(1)]))
    again = hashing.word_digests(pa.chunked_array([column]))
    assert n.tolist() == [2, 0, 2] and one.tolist() == again[1][1:].tolist()


@settings(max_examples=50)
@given(st.integers(0, 2**64 - 1), st.integers(0, 4), st.randoms())
def test_near_fingerprints_share_an_anchor_as_home(x, distance, r):
    y = x
    for b in r.sample(range(64), distance):
        y ^= 1 << b
    for m, p in ((4, 1), (3, 1), (5, 2), (6, 3), (8, 5)):
        homes, visits = set(), set()
        for k, view in enumerate(simhash._views(4, m, p)):
            at, anchor, home = simhash.anchors_of(np.array([x, y], np.uint64), view, k)
            homes |= set(anchor[home & (at == 0)].tolist())
            visits |= set(anchor[at == 1].tolist())
            assert len(set(zip(at.tolist(), anchor.tolist(), strict=True))) == len(at)  # no anchor twice
        assert homes & visits


def test_views_widen_with_the_number_of_fingerprints():
    sizes = [(len(v), sum(w for _, w in v[0])) for v in (simhash.best_views(4, n) for n in (10, 10**7, 10**9, 10**12))]
    assert sizes == [(4, 16), (3, 21), (20, 32), (56, 40)] and simhash._views(4, 2, 1) is None


@settings(max_examples=60)
@given(st.lists(st.integers(1, 63), max_size=60), st.booleans())
def test_packing_keeps_every_token(lengths, last):
    packer = packing.Packer(0, 64, 1.0, 0.1)
    left = packer.pack([(k, np.arange(n, dtype=np.uint32), 0, n) for k, n in enumerate(lengths)], last)
    placed = sum(r[2] for r in packer.rows)
    assert placed + sum(len(p[1]) for p in left) == sum(lengths) and (not left or (not last and sum(len(p[1]) for p in left) < 64))
    used = {}
    for r in packer.rows:
        used.setdefault(r[5], []).append((r[6], r[2]))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0


def test_roots_of_random_graphs():
    r = random.Random(3)
    for _ in range(20):
        n = r.randint(1, 40)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 40))]
        parent = list(range(n))
        for _ in range(n):
            for a, b in edges:
                m = min(parent[a], parent[b])
                parent[a] = parent[b] = m
        a, b = (np.array([e[k] for e in edges], int) for k in (0, 1))
        assert simhash._roots(n, a, b).tolist() == parent
