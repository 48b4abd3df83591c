"""Tail probabilities needed by the regression tables."""

from __future__ import annotations

import math

Z_975 = 1.959963984540054


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def chi2_upper_tail(x: float, d: float) -> float:
    """Regularised upper incomplete gamma function of d/2 at x/2."""
    a, x = d / 2.0, x / 2.0
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    # Continued fraction, from the far end.
    tail = 0.0
    for k in range(400, 0, -1):
        tail = k * (k - a) / (x + 2 * k + 1 - a - tail)
    return front / (x + 1 - a - tail)


# From here on the F distribution is its chi-square limit to about one part in the degrees of freedom.
LIMIT_DF = 1e7


def f_upper_tail(f: float, d1: float, d2: float) -> float:
    if f != f:
        return float("nan")
    if d2 >= LIMIT_DF:
        return chi2_upper_tail(d1 * f, d1)
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)
