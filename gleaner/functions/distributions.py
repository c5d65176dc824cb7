"""Tail probabilities as column expressions, for the few rows of a test result.

Spark has no normal, chi-square or studentized-range distribution. The series
below use only terms of one sign, so they keep full precision.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_PI = math.sqrt(math.pi)
# Two-sided 95 % point of the normal distribution.
NORMAL_975 = 1.959963984540054


def erf(x: Column, terms: int = 160) -> Column:
    """2/sqrt(pi) * e^(-x^2) * sum of 2^n x^(2n+1) / (2n+1)!!"""
    z = F.least(F.abs(x), F.lit(6.0))
    state = F.struct(z.alias("term"), z.alias("total"))
    summed = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), state,
        lambda acc, n: F.struct((acc.term * 2 * z * z / (2 * n + 1)).alias("term"),
                                (acc.total + acc.term * 2 * z * z / (2 * n + 1)).alias("total")),
        lambda acc: acc.total)
    return F.signum(x) * F.lit(2 / SQRT_PI) * F.exp(-z * z) * summed


def erfc(x: Column) -> Column:
    """1 - erf, from the continued fraction where the difference would cancel."""
    z = F.greatest(F.abs(x), F.lit(2.0))
    fraction = F.aggregate(
        F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0),
        lambda acc, k: (k / 2) / (z + acc))
    tail = F.exp(-z * z) / (SQRT_PI * (z + fraction))
    return (F.when(x >= 2, tail).when(x <= -2, 2 - tail).otherwise(1 - erf(x)))


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|)"""
    return erfc(F.abs(z) / math.sqrt(2))


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X >= x) for a whole number of degrees of freedom; terms are summed in log space, so none overflows."""
    h = x / 2

    def series(first: Column, last: Column, shift: float) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(last.cast("int"), F.lit(1))),
            F.struct(first.alias("term"), F.lit(0.0).alias("total")),
            lambda acc, i: F.struct((acc.term + F.log(h / (i + shift))).alias("term"),
                                    (acc.total + F.exp(acc.term - h)).alias("total")),
            lambda acc: acc.total)

    even = series(F.lit(0.0), F.floor(df / 2), 0.0)
    odd = series(F.log(F.sqrt(h) * (2 / SQRT_PI)), F.floor((df - 1) / 2), 0.5)
    odd_part = F.when(df >= 3, odd).otherwise(F.lit(0.0))
    return F.when(x <= 0, F.lit(1.0)).when(df % 2 == 0, even).otherwise(erfc(F.sqrt(h)) + odd_part)


def _bound(value: Column, use) -> Column:
    """``use`` of a column expression that is evaluated once, however often it is named."""
    return F.transform(F.array(value), use)[0]


#: Cells up to which the exact distribution of U is counted; all counts below are whole doubles.
EXACT_CELLS = 2000


def u_counts(n1: Column, n2: Column) -> Column:
    """In how many orders of two samples U takes each of the values 0 to n1 * n2.

    The counts are the coefficients of the product over i = 1..n1 of (1 - x^(n2 + i)) / (1 - x^i), taken one i at a
    time, so that every step ends in whole numbers without a sign.
    """
    cells = (n1 * n2).cast("int")

    def step(counts: Column, i: Column) -> Column:
        # Times 1 - x^(n2 + i), then over 1 - x^i: a running sum in steps of i.
        times = _bound(counts, lambda c: F.transform(c, lambda x, j: x - F.coalesce(F.get(c, (j - n2 - i).cast("int")), F.lit(0.0))))
        return _bound(times, lambda c: F.transform(c, lambda x, j: F.aggregate(
            F.sequence(F.lit(0), F.floor(j / i).cast("int")), F.lit(0.0), lambda total, t: total + F.get(c, (j - t * i).cast("int")))))

    one = F.transform(F.sequence(F.lit(0), cells), lambda j: F.when(j == 0, 1.0).otherwise(0.0))
    return F.aggregate(F.sequence(F.lit(1), n1.cast("int")), one, step)


def u_two_sided(u: Column, n1: Column, n2: Column) -> Column:
    """Exact P(U is as far from its middle as ``u``), both sides, for two tie-free samples."""
    least, most = F.least(n1, n2), F.greatest(n1, n2)
    far = F.greatest(u, n1 * n2 - u)
    return _bound(u_counts(least, most), lambda c: F.least(F.lit(1.0), 2 * F.aggregate(
        F.filter(c, lambda x, j: j >= far), F.lit(0.0), lambda a, x: a + x) / F.aggregate(c, F.lit(0.0), lambda a, x: a + x)))


def _phi(z: float) -> float:
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def _cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def range_tail(q: float, k: int, steps: int = 400, reach: float = 9.0) -> float:
    """P(range of k standard normals >= q); Simpson's rule on its integral."""
    if q <= 0:
        return 1.0
    width = 2 * reach / steps
    total = 0.0
    for i in range(steps + 1):
        z = -reach + i * width
        weight = 1 if i in (0, steps) else (4 if i % 2 else 2)
        total += weight * _phi(z) * (_cdf(z) - _cdf(z - q)) ** (k - 1)
    return max(0.0, 1.0 - k * total * width / 3)


def range_tail_of(q: Column, k: int, steps: int = 400, reach: float = 9.0) -> Column:
    """:func:`range_tail` of a column: the same rule, with its nodes as literals."""
    width = 2 * reach / steps
    nodes = [-reach + i * width for i in range(steps + 1)]
    weights = [(1 if i in (0, steps) else 4 if i % 2 else 2) * _phi(z) * k * width / 3 for i, z in enumerate(nodes)]
    table = F.lit(np.array([[z, w, _cdf(z)] for z, w in zip(nodes, weights)]).ravel())

    def part(total: Column, i: Column) -> Column:
        z, weight, below = (F.get(table, (3 * i + c).cast("int")) for c in range(3))
        return total + weight * F.pow(F.greatest(below - erfc((q - z) / math.sqrt(2)) / 2, F.lit(0.0)), F.lit(float(k - 1)))

    inside = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), part)
    return F.when(q <= 0, F.lit(1.0)).otherwise(F.greatest(1 - inside, F.lit(0.0)))


def range_critical(k: int, alpha: float = 0.05) -> float:
    """The q that ``range_tail`` brings down to ``alpha``, by bisection."""
    low, high = 0.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if range_tail(mid, k) > alpha else (low, mid)
    return (low + high) / 2
