"""Tail probabilities of t, F and χ² for the one result row of a test."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return total


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(statistic: float | None, freedom: float | None) -> float | None:
    """P(|T| >= |statistic|)."""
    if statistic is None or freedom is None or not (freedom > 0) or statistic != statistic:
        return None
    if math.isinf(statistic):
        return 0.0
    return beta_share(freedom / 2, 0.5, freedom / (freedom + statistic * statistic))


def f_tail(statistic: float, top: float, bottom: float) -> float | None:
    """P(F >= statistic)."""
    if not (statistic >= 0 and top > 0 and bottom > 0):
        return None
    return beta_share(bottom / 2, top / 2, bottom / (bottom + top * statistic))


def chi_square_tail_2(statistic: float) -> float:
    """P(χ² >= statistic) with two degrees of freedom."""
    return math.exp(-statistic / 2)
