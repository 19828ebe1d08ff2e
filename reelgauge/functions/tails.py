"""Tail probabilities of t as column expressions, for one test a row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction, two a term; enough for 9 digits at any freedom.
_STEPS = 1_000
_TINY = 1e-300
_SHIFT = 16


def _log_half_step(a: Column) -> Column:
    """ln Γ(a + 1/2) - ln Γ(a) for a > 0, by its series at a + 16: no large terms cancel."""
    y = a + _SHIFT
    inverse = 1 / (y * y)
    series = (-1 / 8 + inverse * (1 / 192 - inverse * (1 / 640 - inverse * 17 / 14336))) / y
    ratio = F.lit(0.0)
    for i in range(_SHIFT):
        ratio += F.log1p(F.lit(-0.5) / (a + i + 0.5))
    return F.log(y) / 2 + series + ratio


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function, by Lentz's method."""

    def kept(value: Column) -> Column:
        return F.when(F.abs(value) > _TINY, value).otherwise(F.lit(_TINY))

    def term(step: Column) -> Column:
        m = F.floor((step + 2) / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(step % 2 == 0, even).otherwise(odd)

    def advance(state: Column, found: Column) -> Column:
        d = 1 / kept(1 + found * state["d"])
        c = kept(1 + found / state["c"])
        return F.struct(c.alias("c"), d.alias("d"), (state["total"] * c * d).alias("total"))

    first = 1 / kept(1 - (a + b) * x / (a + 1))
    begun = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("total"))
    terms = F.transform(F.sequence(F.lit(0), F.lit(_STEPS - 1)), term)
    return F.aggregate(terms, begun, advance, lambda state: state["total"])


def t_two_sided(statistic: Column, freedom: Column) -> Column:
    """P(|T| >= |statistic|); NULL without both, or without positive freedom."""
    a, b = freedom / 2, F.lit(0.5)
    square = statistic * statistic
    x, rest = freedom / (freedom + square), square / (freedom + square)
    # ln x and ln (1 - x), without rounding x to 1 first.
    log_x = -F.log1p(square / freedom)
    front = F.exp(_log_half_step(a) - math.log(math.pi) / 2 + a * log_x + F.log(rest) / 2)
    low = x < (a + 1) / (a + b + 2)
    # The one fraction that converges fast, with its arguments chosen first.
    fraction = _beta_fraction(
        F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(rest)
    )
    tail = F.when(low, front * fraction / a).otherwise(1 - front * fraction / b)
    known = statistic.isNotNull() & ~F.isnan(statistic) & (freedom > 0)
    endless = F.abs(statistic) == F.lit(float("inf"))
    return (
        F.when(~known, F.lit(None).cast("double"))
        .when(endless, F.lit(0.0))
        .when(statistic == 0, F.lit(1.0))
        .when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
    )
