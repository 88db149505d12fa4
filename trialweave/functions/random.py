"""Seeded draws that depend only on (seed, name, index): the same on any partitioning, run and engine.

``unit`` reads 52 bits of an md5, which any SQL engine can repeat; ``fast_unit``
hashes with xxhash64 and is the one to use where no other engine has to agree.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = float(1 << 52)


def unit(seed: int, name: str, index: Column) -> Column:
    """Uniform in [0, 1)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(name), index.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / _BITS


def fast_unit(seed: int, name: str, index: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), index), F.lit(1 << 52)).cast("double") / _BITS


def uniform(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high) - float(low))


def loguniform(u: Column, low: float, high: float) -> Column:
    a, b = math.log(low), math.log(high)
    return F.exp(F.lit(a) + u * F.lit(b - a))


def int_uniform(u: Column, low: int, high: int) -> Column:
    return F.floor(F.lit(float(low)) + u * F.lit(float(high - low + 1))).cast("long")


def normal(u: Column, v: Column, low: float, high: float) -> Column:
    """Mean in the middle of the bounds, standard deviation a sixth of their distance, not truncated (Box-Muller)."""
    z = F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)
    return F.lit((low + high) / 2.0) + z * F.lit((high - low) / 6.0)


_PRIME = (1 << 31) - 1


def permutation_keys(seed: int, name: str, rounds: int = 48) -> list[tuple[int, int, int, int]]:
    """Whole numbers (k, c, a, b) of each round of ``permuted``."""
    r = random.Random(f"{seed}:{name}")
    return [(r.randrange(1 << 61), *(r.randrange(1, _PRIME) for _ in range(3))) for _ in range(rounds)]


def permuted(index: Column, n: Column, seed: int, name: str, batch: Column) -> Column:
    """A pseudo-random permutation of 0..n-1 for each ``batch``, row by row: a swap-or-not shuffle.

    In each round every number has a partner, (key - number) modulo n, and a bit
    drawn for the two together says whether they change places: a permutation
    of any n, with nothing to search for.  Keys are linear in the batch, bits in
    the larger partner, modulo the prime 2 ** 31 - 1, so that any SQL engine can
    repeat them.
    """
    keys = F.expr("array(" + ", ".join(f"named_struct('k', {k}L, 'c', {c}L, 'a', {a}L, 'b', {b}L)" for k, c, a, b in permutation_keys(seed, name)) + ")")

    def once(x: Column, key: Column) -> Column:
        partner = F.pmod((key["k"] + (batch % _PRIME) * key["c"] % _PRIME) % n - x, n)
        bit = F.shiftright(((F.greatest(x, partner) % _PRIME) * key["a"] + key["b"]) % _PRIME, 12).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, partner).otherwise(x)

    return F.aggregate(keys, index.cast("long"), once)
