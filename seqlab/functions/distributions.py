"""Tail probabilities of model tables (I-11) as column expressions.

Student t and F probabilities come from the regularised incomplete beta
function, evaluated by its continued fraction (modified Lentz method) as an
``aggregate`` over a fixed sequence; the normal distribution from its power
series and, in the tails, the continued fraction of the Mills ratio.  The
expressions run in the JVM on coefficient tables of a few rows.  A null
argument, or degrees of freedom that are not positive, gives null.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction of the incomplete beta function (35 suffice for 1 to 10^10 degrees of freedom).
STEPS = 100
_TINY = 1e-300


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def lgamma(x: Column) -> Column:
    """log Gamma of x >= 1/2: Stirling's series at x + 10, less the ten factors."""
    y = x + 10
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5)
    return series - sum((F.ln(x + i) for i in range(10)), F.lit(0.0))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    def away(v):
        return F.when(F.abs(v) > _TINY, v).otherwise(F.lit(_TINY))

    start = F.struct(F.lit(1.0).alias("c"), (1 / away(1 - (a + b) * x / (a + 1))).alias("d"),
                     (1 / away(1 - (a + b) * x / (a + 1))).alias("h"))

    def half(state, factor):
        d, c = 1 / away(1 + factor * state["d"]), away(1 + factor / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["h"] * d * c).alias("h"))

    # two half steps for every m: the even one at 2 m, the odd one at 2 m + 1
    def step(state, s):
        m = F.floor(s / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return half(state, F.when(s % 2 == 0, even).otherwise(odd))

    return F.aggregate(F.sequence(F.lit(2), F.lit(2 * STEPS + 1)), start, step, lambda s: s["h"])


def betainc(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """Regularised incomplete beta I_x(a, b); ``rest`` is 1 - x, which the caller knows without loss."""
    # two large logarithms would lose the digits of their small difference
    grown = F.when(a > 1e6, b * F.ln(a) + b * (b - 1) / (2 * a)).otherwise(lgamma(a + b) - lgamma(a))
    ln_x = F.when(rest < 0.5, F.log1p(-rest)).otherwise(F.ln(x))
    front = F.exp(grown - lgamma(b) + a * ln_x + b * F.ln(rest))
    value = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, rest) / b)
    return F.when(x <= 0, F.lit(0.0)).when(rest <= 0, F.lit(1.0)).otherwise(value)


def p_value(t: Column | str, df: Column | str) -> Column:
    """Two-sided p-value of a t statistic with ``df`` degrees of freedom."""
    t, df = _col(t), _col(df)
    # far beyond 10^7 degrees of freedom x is too near 1; there the normal distribution is as exact (error of order 1 / df^2)
    z = t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df))
    return F.when(df > 1e7, z_p_value(z)).when(df > 0, betainc(df / 2, F.lit(0.5), df / (df + t * t), t * t / (df + t * t)))


def f_p_value(f: Column | str, between: Column | str, within: Column | str) -> Column:
    """Upper tail of an F statistic with ``between`` and ``within`` degrees of freedom."""
    f, p, q = _col(f), _col(between), _col(within)
    p_f = F.greatest(f, F.lit(0.0)) * p
    return F.when((p > 0) & (q > 0) & f.isNotNull(), betainc(q / 2, p / 2, q / (q + p_f), p_f / (q + p_f)))


def _density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def normal_middle(z: Column) -> Column:
    """P(0 < Z < z) of a standard normal Z for 0 <= z < 6, by its power series."""
    start = F.struct(z.alias("term"), z.alias("total"))

    def step(s, k):
        term = s["term"] * z * z / (2 * k + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return _density(z) * F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step, lambda s: s["total"])


def z_p_value(z: Column | str) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    z = F.abs(_col(z))
    mills = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), z, lambda acc, k: z + k / acc, lambda acc: 1 / acc)
    return F.when(z < 3, 1 - 2 * normal_middle(z)).otherwise(2 * _density(z) * mills)


def normal_quantile_middle(h: Column) -> Column:
    """The z with P(0 < Z < z) = h, for 0 <= h < 1/2, by Newton's method from 0 (convex there, so it converges)."""
    # from 0 the first step undershoots and the iterates rise; in the tails steps stay below the target
    return F.when(h >= 0.5, F.lit(None)).otherwise(F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.lit(0.0), lambda z, _: z + (h - normal_middle(z)) / _density(z)))
