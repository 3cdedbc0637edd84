"""Distribution functions in plain Python, for the few numbers that a test ends with."""

from __future__ import annotations

import math


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma."""
    if x <= 0:
        return 0.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * head
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - head * h


def chi2_sf(x: float, k: float) -> float:
    return 1 - _gamma_p(k / 2, x / 2)


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return _beta_i(df / 2, 0.5, df / (df + t * t))


def chi2_quantile(q: float, k: float) -> float:
    lo, hi = 0.0, 1.0
    while chi2_sf(hi, k) > 1 - q:
        hi *= 2
    while hi - lo > 1e-10 * max(1.0, hi):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_sf(mid, k) > 1 - q else (lo, mid)
    return hi


def skew_test(n: int, skewness: float) -> tuple[float, float]:
    """z and two-sided p of D'Agostino's test of zero skewness; NaN below 8 values or without variance; as is usual, a skewness of exactly 0 counts as a standardised 1."""
    if n < 8 or math.isnan(skewness):
        return math.nan, math.nan
    y = skewness * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) or 1.0
    kurtosis = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (kurtosis - 1)) - 1
    z = math.asinh(y * math.sqrt((w2 - 1) / 2)) / math.sqrt(math.log(w2) / 2)
    return z, math.erfc(abs(z) / math.sqrt(2))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: all tables of the same margins that are no likelier."""
    row, col, n = a + b, a + c, a + b + c + d

    def log_choose(m: int, k: int) -> float:
        return math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)

    def log_p(x: int) -> float:
        return log_choose(row, x) + log_choose(n - row, col - x) - log_choose(n, col)

    limit = log_p(a) + 1e-7
    return min(1.0, math.fsum(math.exp(v) for x in range(max(0, row + col - n), min(row, col) + 1) if (v := log_p(x)) <= limit))
