"""Scalar distribution tails used on one-row results (no SciPy here)."""

from __future__ import annotations

import math


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    """Upper tail 1 − Φ(x), accurate far into the tail."""
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularised incomplete beta (modified Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    ln_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(ln_front) * _betacf(a, b, x) / a
    return 1.0 - math.exp(ln_front) * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float | None, df: float | None) -> float | None:
    """Two-sided p-value of Student's t with ``df`` degrees of freedom."""
    if t is None or df is None or df <= 0 or math.isnan(t):
        return None
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def shapiro_p(w: float | None, n: int | None) -> float | None:
    """Royston (1995) p-value for the Shapiro–Wilk W."""
    if w is None or n is None or n < 3:
        return None
    if n == 3:
        # Exact distribution for three points.
        p = 6.0 / math.pi * (math.asin(math.sqrt(min(max(w, 0.75), 1.0))) - math.asin(math.sqrt(0.75)))
        return max(p, 0.0)
    if w >= 1.0:
        return 1.0
    ln1w = math.log(1.0 - w)
    if n <= 11:
        # Royston's small-sample fit (4 <= n <= 11).
        gamma = 0.459 * n - 2.273
        mu = 0.544 - 0.39978 * n + 0.025054 * n ** 2 - 0.0006714 * n ** 3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n ** 2 - 0.0020322 * n ** 3)
        if gamma - ln1w <= 0:
            return 0.0
        z = (-math.log(gamma - ln1w) - mu) / sigma
    else:
        # Royston's fit for n >= 12.
        ln = math.log(n)
        mu = 0.0038915 * ln ** 3 - 0.083751 * ln ** 2 - 0.31082 * ln - 1.5861
        sigma = math.exp(0.0030302 * ln ** 2 - 0.082676 * ln - 0.4803)
        z = (ln1w - mu) / sigma
    return norm_sf(z)


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series below a+1,
    continued fraction above)."""
    if x <= 0:
        return 1.0
    ln_front = -x + a * math.log(x) - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        ap = a
        for _ in range(10000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return max(0.0, 1.0 - total * math.exp(ln_front))
    tiny = 1e-300
    b = x + 1.0 - a
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-16:
            break
    return math.exp(ln_front) * h


def chi2_sf(stat: float | None, dof: float | None) -> float | None:
    """Upper tail of the chi-square distribution."""
    if stat is None or dof is None or dof <= 0:
        return None
    return gammaincc(dof / 2.0, stat / 2.0)


def f_sf(stat: float | None, d1: float | None, d2: float | None) -> float | None:
    """Upper tail of the F distribution."""
    if stat is None or d1 is None or d2 is None or d1 <= 0 or d2 <= 0 or stat != stat:
        return None
    if stat <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * stat))
