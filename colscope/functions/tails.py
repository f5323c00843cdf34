"""Tail probabilities of test statistics.

Statistics arrive as small frames, one row per test; the tails are scalar functions applied to those
rows through Pandas UDFs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return h


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


# Above this sample size the reference distribution of the two-sample test is the limiting one, unless told otherwise.
KS_EXACT_ROWS = 10_000


def ks_two_sided(d: float, n1: int, n2: int, exact_rows: int = KS_EXACT_ROWS) -> float:
    """Two-sample Kolmogorov-Smirnov p: exact path counting up to `exact_rows` a side, else the limit law."""
    if max(n1, n2) <= exact_rows:
        return _ks_exact(d, n1, n2)
    root = math.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + 0.12 + 0.11 / root) * d
    if lam < 0.2:
        return 1.0
    total = sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


def _ks_exact(d: float, n1: int, n2: int) -> float:
    """Chance that a random lattice path from (0, 0) to (m, n) strays at least d from the diagonal.

    Swept by anti-diagonals: a path reaches (i, j) after i + j steps, the last one with odds i : j.
    """
    m, n = max(n1, n2), min(n1, n2)
    bound = round(d * m * n)
    j = np.arange(n + 1, dtype="float64")
    stay = np.zeros(n + 1)
    stay[0] = 1.0 if bound > 0 else 0.0
    for step in range(1, m + n + 1):
        i = step - j
        from_below = np.concatenate(([0.0], stay[:-1]))
        stay = (i * stay + j * from_below) / step
        stay[(i < 0) | (i > m) | (np.abs(i * n - j * m) >= bound)] = 0.0
    return float(min(1.0, max(0.0, 1.0 - stay[n])))


def _udf(fn):
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(
            [None if pd.isna(x) or pd.isna(y) or pd.isna(z) else fn(float(x), float(y), float(z))
             for x, y, z in zip(a, b, c)], dtype="float64")

    return tail


def t_p_value(t, dof):
    """Two-sided p of a t statistic."""
    return _udf(lambda x, d, _: t_two_sided(x, d))(t, dof, F.lit(0.0))


def f_p_value(f, d1, d2):
    return _udf(f_upper)(f, d1, d2)


def chi2_p_value(x, dof):
    return _udf(lambda v, d, _: chi2_upper(v, d))(x, dof, F.lit(0.0))


def ks_p_value(d, n1, n2, exact_rows: int = KS_EXACT_ROWS):
    return _udf(lambda v, a, b: ks_two_sided(v, int(a), int(b), exact_rows))(d, n1, n2)
