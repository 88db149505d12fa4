"""Plain-Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Int(int):
    """A number that the engine holds in four bytes."""


def spark_hash(*values):
    """The engine's xxhash64 of texts and whole numbers, nulls left out, as a signed number."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, Int) else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h % (1 << 64))
    return h - (1 << 64) if h >> 63 else h


def water(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, share * sum(sizes.values()), set(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def words(text):
    return WORD.findall(text or "")


def remove_repeats(docs, width):
    count = Counter(tuple(w[i : i + width]) for _, t in docs for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for doc_id, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone |= set(range(i, i + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs, threshold=4):
    fps = [(d, fingerprint(t)) for d, t in docs]
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i][1] ^ fps[j][1]).count("1") <= threshold:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(fps):
        least[find(i)].append(d)
    return sorted(((d, f"{f:016x}", min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, f) in enumerate(fps)), key=repr)


def counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
