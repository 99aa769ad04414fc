"""Tail probabilities (Student t, F, chi-square, normal) in plain Python.

Used only on result-sized tables (one row per year x feature, per model
coefficient, ...) through pandas UDFs; scipy is not available.
Incomplete beta / gamma by the classical continued-fraction and series
expansions (Press et al., Numerical Recipes, ch. 6).
"""

from __future__ import annotations

import math
from statistics import NormalDist

_N01 = NormalDist()


def _betacf(a: float, b: float, x: float, itmax: int = 500, eps: float = 3e-16) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1e-300 if abs(d) < 1e-300 else d
        c = 1.0 + aa / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1e-300 if abs(d) < 1e-300 else d
        c = 1.0 + aa / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_sf2(t: float, df: float) -> float | None:
    """Two-sided p-value of a Student t statistic."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float | None:
    """Upper tail of the F distribution."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return None
    if math.isinf(f):
        return 0.0
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def _gammainc_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x)."""
    if x <= 0:
        return 0.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 3e-16:
                break
        return s * math.exp(-x + a * math.log(x) - gln)
    b = x + 1.0 - a
    c, d = 1.0 / 1e-300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 3e-16:
            break
    return 1.0 - math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf(x: float, k: float) -> float | None:
    if x is None or math.isnan(x):
        return None
    if math.isinf(x):
        return 0.0
    return 1.0 - _gammainc_lower(k / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    return 1.0 - _N01.cdf(z)


def norm_ppf(p: float) -> float:
    return _N01.inv_cdf(p)
