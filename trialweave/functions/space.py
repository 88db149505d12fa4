"""Scaling, grids and low-discrepancy points as column expressions."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def linspace(position: Column, low: float, high: float, n: int) -> Column:
    """Point ``position`` of ``n`` evenly spaced ones, both ends included; a single point is ``low``."""
    low, high = float(low), float(high)
    if n == 1:
        return F.lit(low)
    return F.when(position == n - 1, F.lit(high)).otherwise(position * F.lit((high - low) / (n - 1)) + F.lit(low))


def digit(index: Column, sizes: list[int], k: int) -> Column:
    """Digit ``k`` of ``index`` in mixed radix ``sizes``; the last digit changes fastest."""
    below = int(np.prod(sizes[k + 1 :], dtype=object)) if k + 1 < len(sizes) else 1
    return F.floor(index / F.lit(below)).cast("long") % sizes[k] if below > 1 else index % sizes[k]


def normalize(x: Column, low: float, high: float) -> Column:
    return (x - F.lit(float(low))) / F.lit(float(high) - float(low))


def standardized(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column`` less its mean, in sample standard deviations (1 where they are zero or there is one row)."""
    value = F.col(column).cast("double")
    moments = df.agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))  # one row
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(F.lit(1.0))
    return df.crossJoin(F.broadcast(moments)).withColumn(column, (value - F.col("_mean")) / sd).drop("_mean", "_sd")


def best_of(value: Column, at: Column) -> Column:
    """An aggregate: the greatest ``value`` (as ``best``) and the least ``at`` that has it."""
    found = F.max(F.struct(value.alias("best"), (-at).alias("at")))
    return F.struct(found["best"].alias("best"), (-found["at"]).alias("at"))


def unnormalize(x: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + x * F.lit(float(high) - float(low))


#: Joe and Kuo's primitive polynomials and initial direction numbers (degree, coefficients, m...), from dimension 2.
SOBOL_TABLE = [
    (1, 0, [1]),
    (2, 1, [1, 3]),
    (3, 1, [1, 3, 1]),
    (3, 2, [1, 1, 1]),
    (4, 1, [1, 1, 3, 3]),
    (4, 4, [1, 3, 5, 13]),
    (5, 2, [1, 1, 5, 5, 17]),
    (5, 4, [1, 1, 5, 5, 5]),
    (5, 7, [1, 1, 7, 11, 19]),
    (5, 11, [1, 1, 5, 1, 1]),
    (5, 13, [1, 1, 1, 3, 11]),
    (5, 14, [1, 3, 5, 5, 31]),
    (6, 1, [1, 3, 3, 9, 7, 49]),
    (6, 13, [1, 1, 1, 15, 21, 21]),
    (6, 16, [1, 3, 1, 13, 27, 49]),
]
SOBOL_BITS = 32


def sobol_directions(dim: int, bits: int = SOBOL_BITS) -> list[int]:
    """Direction numbers of dimension ``dim`` (from 0) as ``bits``-bit integers."""
    if dim == 0:
        return [1 << (bits - 1 - k) for k in range(bits)]
    degree, coefficients, m = SOBOL_TABLE[dim - 1] if dim <= len(SOBOL_TABLE) else _further_dimension(dim)
    v = [m[k] << (bits - 1 - k) for k in range(min(degree, bits))]
    for k in range(degree, bits):
        x = v[k - degree] ^ (v[k - degree] >> degree)
        for j in range(1, degree):
            if coefficients >> (degree - 1 - j) & 1:
                x ^= v[k - j]
        v.append(x)
    return v


def _times(a: int, b: int, modulus: int) -> int:
    """The product of two polynomials over the field of two elements, modulo a third; bits are coefficients."""
    out, top = 0, 1 << (modulus.bit_length() - 1)
    while b:
        if b & 1:
            out ^= a
        b, a = b >> 1, a << 1
        if a & top:
            a ^= modulus
    return out


def _is_primitive(polynomial: int) -> bool:
    """Whether x has the order 2 ** degree - 1 modulo ``polynomial``."""
    order = (1 << (polynomial.bit_length() - 1)) - 1

    def power(n: int) -> int:
        out, base = 1, _times(1, 2, polynomial)
        while n:
            out, base, n = _times(out, base, polynomial) if n & 1 else out, _times(base, base, polynomial), n >> 1
        return out

    rest, primes, p = order, [], 2
    while p * p <= rest:
        if rest % p == 0:
            primes.append(p)
            while rest % p == 0:
                rest //= p
        p += 1
    primes += [rest] if rest > 1 else []
    return power(order) == 1 and all(power(order // p) != 1 for p in primes if p < order or order == 1)


@cache
def primitive_polynomials(n: int) -> list[int]:
    """The first ``n`` primitive polynomials over the field of two elements, by degree and then as numbers."""
    found, degree = [], 1
    while len(found) < n:
        found += [p for p in range((1 << degree) + 1, 1 << (degree + 1), 2) if _is_primitive(p)]
        degree += 1
    return found[:n]


def _further_dimension(dim: int) -> tuple[int, int, list[int]]:
    """A dimension beyond the table: the next primitive polynomial, and odd initial numbers drawn by a seeded rule."""
    polynomial = primitive_polynomials(64 * -(-dim // 64))[dim - 1]
    degree = polynomial.bit_length() - 1
    draw = random.Random(f"sobol:{dim}")
    return degree, (polynomial >> 1) & ((1 << (degree - 1)) - 1), [2 * draw.randrange(1 << k) + 1 for k in range(degree)]


#: Even multipliers of the hash that permutes digits: each bit of a product depends on lower bits only.
OWEN_MULTIPLIERS = (0x6C50B47C, 0xB82F1E52, 0xC7AFE638, 0x8D22F6E6)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _word(x: Column) -> Column:
    return x.bitwiseAND(_long((1 << SOBOL_BITS) - 1))


def _swapped(by: int, low: int) -> Callable[[Column], Column]:
    """Neighbouring groups of ``by`` bits change places; ``low`` marks the lower group of each two."""
    return lambda x: F.shiftleft(x.bitwiseAND(_long(low)), by).bitwiseOR(F.shiftright(x, by).bitwiseAND(_long(low)))


def _hashed(multiplier: int) -> Callable[[Column], Column]:
    """Less 2 ** 32 where it is 2 ** 31 or more, which is the same modulo 2 ** 32, so that no product leaves 64 bits."""
    signed = multiplier - (1 << SOBOL_BITS) if multiplier >> (SOBOL_BITS - 1) else multiplier
    return lambda x: x.bitwiseXOR(_word(x * _long(signed)))


#: Steps that put the bits of a whole number below 2 ** 32 in reverse order.
_REVERSAL = [_swapped(by, low) for by, low in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF))]


def _owen_steps(key: int) -> list[Callable[[Column], Column]]:
    """From reversed digits to permuted ones.  Steps read a number several times, so each has to be bound before the next: put into one another, they hold it thousands of times."""
    return [lambda x: _word(x + _long(key)), *map(_hashed, OWEN_MULTIPLIERS), *_REVERSAL]


def owen_scrambled(bits: Column, key: int) -> Column:
    """A nested uniform permutation of the binary digits of ``bits`` < 2 ** 32: each is flipped or not by a hash of ``key`` and the digits before it.

    Reversed, a digit comes after those that may decide on it; sums and products
    with even numbers carry upwards only.  Steps are bound by lambdas, which Spark
    interprets; for tables there is ``with_owen_sobol``.
    """
    return reduce(F.transform, [*_REVERSAL, *_owen_steps(key)], F.array(bits))[0]


def sobol_array(n: int, dims: int, seed: int = 0) -> np.ndarray:
    """The first ``n`` Sobol points of the unit cube with a seeded digital shift, for small designs on the driver or in a task."""
    index = np.arange(n, dtype=np.int64)
    gray, out = index ^ (index >> 1), np.empty((n, dims))
    for k in range(dims):
        bits = np.full(n, random.Random(f"{seed}:{k}").getrandbits(SOBOL_BITS), np.int64)
        for j, v in enumerate(sobol_directions(k)[: max(1, n.bit_length())]):
            bits ^= (gray >> j & 1) * np.int64(v)
        out[:, k] = (bits + 0.5) / 2.0**SOBOL_BITS
    return out


def _gray(index: Column) -> Column:
    index = index.cast("long")
    return index.bitwiseXOR(F.shiftright(index, 1))


def _sum_of(directions: list[int], gray: Column, shift: int = 0) -> Column:
    """The exclusive or of ``shift`` and the directions whose bit is set: moved to the sign and back, a bit fills the word."""
    parts = [F.shiftright(F.shiftleft(gray, 63 - k), 63).bitwiseAND(_long(v)) for k, v in enumerate(directions)]
    return reduce(lambda a, b: a.bitwiseXOR(b), parts, _long(shift))


def _fraction(bits: Column) -> Column:
    return bits.cast("double") / float(1 << SOBOL_BITS)


def sobol(index: Column, dim: int, log2_points: int, shift: int = 0, owen: int | None = None) -> Column:
    """Coordinate ``dim`` of Sobol point ``index`` < 2 ** log2_points in [0, 1), in Gray-code order.

    ``shift`` is a digital shift, ``owen`` the key of a nested permutation of the digits.
    """
    bits = _sum_of(sobol_directions(dim)[: max(1, log2_points)], _gray(index), shift)
    return _fraction(bits if owen is None else owen_scrambled(bits, owen))


def with_owen_sobol(rows: DataFrame, index: Column, points: dict[str, tuple[int, int]], log2_points: int) -> DataFrame:
    """``rows`` with the coordinates ``points`` (name: dimension and key) that ``sobol`` has with ``owen``, in generated code.

    Each step is a column that the next one reads: Spark computes it once a row,
    and the plan grows with the number of steps.  Digits are summed in reverse order,
    and nulls are set at the end only, to keep the code within what Java compiles.
    """
    out = rows.withColumn("_index", index)
    gray, reverse = _gray(F.coalesce("_index", _long(0))), lambda v: int(f"{v:0{SOBOL_BITS}b}"[::-1], 2)
    out = out.withColumn("_gray", gray).withColumns({name: _sum_of([reverse(v) for v in sobol_directions(dim)[: max(1, log2_points)]], F.col("_gray")) for name, (dim, _) in points.items()})
    for steps in zip(*[_owen_steps(key) for _, key in points.values()], strict=True):
        out = out.withColumns({name: step(F.col(name)) for name, step in zip(points, steps, strict=True)})
    return out.withColumns({name: F.when(F.col("_index").isNotNull(), _fraction(F.col(name))) for name in points}).drop("_index", "_gray")
