"""Tail probabilities of test statistics: one scalar per test, computed on the driver."""

from __future__ import annotations

import math


def chi2_sf(x: float, dof: float) -> float:
    """P(chi-square with ``dof`` degrees of freedom > x): upper regularised incomplete gamma."""
    a, x = dof / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # power series of the lower function
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    return scale * _continued_fraction(
        lambda i: 1.0 if i == 1 else -(i - 1) * (i - 1 - a), lambda i: x + 2 * i - 1 - a
    )


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F(d1, d2) > f): regularised incomplete beta at d2 / (d2 + d1 f)."""
    if f <= 0:
        return 1.0
    return _beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1 - x, b, a)
    scale = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )

    def numerator(i: int) -> float:
        if i == 1:
            return 1.0
        m, odd = divmod(i - 1, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    return scale / a * _continued_fraction(numerator, lambda i: 1.0)


def _continued_fraction(numerator, denominator) -> float:
    """Value of n1/(d1 + n2/(d2 + ...)) by the modified Lentz method."""
    tiny = 1e-300
    value, c, d = tiny, tiny, 0.0
    for i in range(1, 10_000):
        d = denominator(i) + numerator(i) * d
        c = denominator(i) + numerator(i) / c
        d = 1.0 / (d or tiny)
        c = c or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value
