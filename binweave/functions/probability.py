"""Two-sided p-values of correlations, without scipy."""

from __future__ import annotations

import math


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for m in range(500):
        k = m // 2
        if m == 0:
            term = 1.0
        elif m % 2 == 0:
            term = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            term = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1) / a


def correlation_p(r: float, n: int) -> float:
    """P-value of a correlation of n pairs: Student's t with n - 2 degrees of freedom."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))
