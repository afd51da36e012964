"""Tails of distributions as column expressions: chances beside the figures that they belong to, however many rows.

Spark has no special functions, so they are made of array functions: a logarithm of gamma by its asymptotic series, the
incomplete beta function by its continued fraction, and integrals as weighted sums over fixed points.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms of the continued fraction; it settles after some square root of the larger parameter.
TERMS = 1200
#: Points of an integral.
POINTS = 64
_TINY = 1e-300
_SHIFT = 10


def _of(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def ln_gamma(x) -> Column:
    """The logarithm of gamma for positive x. Small x go up by the recurrence first."""
    x = _of(x)
    low = reduce(lambda a, b: a * b, (x + k for k in range(_SHIFT)))
    y = F.when(x < _SHIFT, x + _SHIFT).otherwise(x)
    # Bernoulli numbers over 2k (2k - 1)
    series = reduce(lambda a, b: a + b, (F.lit(c) / F.pow(y, F.lit(float(2 * k + 1))) for k, c in enumerate((1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188))))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.when(x < _SHIFT, F.log(low)).otherwise(0.0)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, from the top down by the ratios of its convergents."""

    def coefficient(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    away = lambda v: F.when(F.abs(v) < _TINY, _TINY).otherwise(v)

    def step(state: Column, k: Column) -> Column:
        # a state that has settled stays
        ratio = coefficient(k)
        d, c = 1 / away(1 + ratio * state["d"]), away(1 + ratio / state["c"])
        new = F.struct(c.alias("c"), d.alias("d"), (state["h"] * c * d).alias("h"), (F.abs(c * d - 1) < 1e-15).alias("done"))
        return F.when(state["done"], state).otherwise(new)

    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("h"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: 1 / s["h"])


def beta_share(a, b, x) -> Column:
    """The regularised incomplete beta function: the share of the beta distribution up to x; null for null."""
    # parameters and x as numbers, so that each is worked out once
    return _let(F.struct(_of(a).alias("a"), _of(b).alias("b"), _of(x).alias("x")), lambda v: _beta_share(v["a"], v["b"], v["x"]))


def _beta_share(a: Column, b: Column, x: Column) -> Column:
    # the fraction settles fast below the mean; above it the other tail is worked out
    high = x > (a + 1) / (a + b + 2)
    parts = F.struct(F.when(high, b).otherwise(a).alias("a"), F.when(high, a).otherwise(b).alias("b"), F.when(high, 1 - x).otherwise(x).alias("x"))

    def lower(v: Column) -> Column:
        front = F.exp(ln_gamma(v["a"] + v["b"]) - ln_gamma(v["a"]) - ln_gamma(v["b"]) + v["a"] * F.log(v["x"]) + v["b"] * F.log(1 - v["x"])) / v["a"]
        return front * _fraction(v["a"], v["b"], v["x"])

    found = _let(parts, lower)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(high, 1 - found).otherwise(found))


def f_tail(f, df1, df2) -> Column:
    """The chance of a larger F. 1 where f isn't positive, 0 where it is infinite, null where it is null or no number."""
    f, df1, df2 = _of(f), _of(df1), _of(df2)
    return F.when(F.isnan(f) | (df1 <= 0) | (df2 <= 0), None).when(f <= 0, 1.0).when(f == float("inf"), 0.0).otherwise(beta_share(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)))


def t_tail(t, df) -> Column:
    """The chance of a larger t, either side."""
    return f_tail(F.pow(_of(t), F.lit(2.0)), 1.0, df)


def normal_share(x: Column) -> Column:
    """The share of the normal distribution up to x, within 1E-7: a polynomial in 1 / (1 + p |x|)."""
    # The coefficients of that approximation.
    p, coefficients = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    sum_ = reduce(lambda a, c: (a + c) * t, reversed(coefficients), F.lit(0.0))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * sum_
    return F.when(x > 0, 1 - upper).otherwise(upper)


def range_tail(q, groups, df) -> Column:
    """The chance of a larger studentized range of so many groups. The range of normal values is integrated over the place
    of the largest, then over how far the deviation, with df degrees of freedom, may be off."""
    points, weights = np.polynomial.legendre.leggauss(POINTS)
    # 8 deviations either side hold all but 1E-15
    z = 8 * points
    place = F.array(*(F.struct(F.lit(float(x)).alias("z"), F.lit(float(w)).alias("w"), F.lit(0.5 * math.erfc(-float(x) / math.sqrt(2))).alias("below")) for x, w in zip(z, 8 * weights * np.exp(-z * z / 2) / math.sqrt(2 * math.pi))))
    steps = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(w)).alias("w")) for x, w in zip((points + 1) / 2, weights / 2)))

    def chance(v: Column) -> Column:
        q, k, n = v["q"], v["k"], v["n"]
        width = 8 / F.sqrt(2 * n)
        low = F.greatest(F.lit(0.0), 1 - width)
        span = 1 + width - low
        scale = math.log(2) + n / 2 * F.log(n / 2) - ln_gamma(n / 2)

        def within(s: Column) -> Column:
            return k * F.aggregate(place, F.lit(0.0), lambda a, p: a + p["w"] * F.pow(F.greatest(F.lit(0.0), p["below"] - normal_share(p["z"] - q * s)), k - 1))

        def add(total: Column, step: Column) -> Column:
            s = low + span * step["x"]
            density = F.exp(scale + (n - 1) * F.log(s) - n * s * s / 2)
            return total + step["w"] * span * density * within(s)

        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.aggregate(steps, F.lit(0.0), add)))

    values = F.struct(_of(q).alias("q"), _of(groups).alias("k"), _of(df).alias("n"))
    return F.when(_of(q) <= 0, 1.0).otherwise(_let(values, chance))
