"""Analytic test functions and reductions of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default coefficients of the test functions, in the order of the functions' arguments.
GAUSSIAN_1D = (0.2, 1.0, 0.001, 0.2, 0.6, 0.01, 0.7)
GAUSSIAN_2D = (0.2, 0.1, 1.0, 0.02, 0.3, 0.3, 0.8, 0.04, 0.75, 0.6)


def _bump(height: float, width: float, gaps: list[Column]) -> Column:
    return F.lit(float(height)) * F.exp(-reduce(lambda a, b: a + b, [g * g for g in gaps]) / F.lit(float(width)))


def double_gaussian_1d(x: Column, p: list[float]) -> Column:
    """slope * x and two bumps (height, width, centre); ``p`` has 7 coefficients."""
    slope, *bumps = p
    return F.lit(float(slope)) * x + _bump(bumps[0], bumps[1], [x - float(bumps[2])]) + _bump(bumps[3], bumps[4], [x - float(bumps[5])])


def double_gaussian_2d(x: Column, y: Column, p: list[float]) -> Column:
    """A plane and two bumps (height, width, centre x, centre y); ``p`` has 10 coefficients."""
    a, b, *c = p
    plane = F.lit(float(a)) * x + F.lit(float(b)) * y
    return plane + _bump(c[0], c[1], [x - float(c[2]), y - float(c[3])]) + _bump(c[4], c[5], [x - float(c[6]), y - float(c[7])])


def total(columns: list[Column]) -> Column:
    """Sum of the columns; 0 of none."""
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def leaf_sum(value: Column) -> Column:
    """Sum over a numeric array."""
    return F.aggregate(value.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
