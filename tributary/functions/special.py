"""Small exact distributions for driver-side tests, without scipy."""

from __future__ import annotations

import math


def binomial_p(successes: int, trials: int, two_sided: bool = False) -> float:
    """Exact test of a fair coin: chance of as many successes or more, or of anything as unlikely."""
    if not trials:
        return math.nan
    weight = [math.comb(trials, i) for i in range(trials + 1)]
    own = weight[successes]
    hit = sum(w for i, w in enumerate(weight) if (w <= own if two_sided else i >= successes))
    return min(1.0, hit / 2**trials)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_tail(t: float, df: float) -> float:
    """P(T > t)."""
    half = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return half if t >= 0 else 1 - half


def spearman_p(rho: float, n: int) -> float:
    """One-sided p-value of a positive rank correlation."""
    if n < 3 or math.isnan(rho):
        return math.nan
    if abs(rho) >= 1:
        return 0.0 if rho > 0 else 1.0
    return student_tail(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
