"""Normal, t and chi-square functions, effect rows, and weighted two-parameter fits.

Spark has no ``erf``; ``norm_cdf`` is a Column.  The t and chi-square
functions run as Arrow-batched helpers on result rows (one row per model or
pool), never on data rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96
# rational-exponential fit of erfc, relative error below 1.2e-7 everywhere (so tails keep digits)
_ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807,
         -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def norm_cdf(z: Column) -> Column:
    a = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * a)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = poly * t + c
    tail = t * F.exp(poly - a * a) / 2.0
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def ln(v: Column, plus: float = 0.0) -> Column:
    """Natural log of ``plus + v`` for plus 0 or 1: minus infinity at zero and NaN below it, where Spark's is null."""
    at = F.lit(-plus)
    return F.when(v == at, float("-inf")).when(v < at, float("nan")).otherwise(F.log1p(v) if plus else F.log(v))


def pct(beta: Column) -> Column:
    """Log effect to percent change."""
    return 100.0 * (F.exp(beta) - 1.0)


def coef_columns(beta: Column, se: Column) -> dict[str, Column]:
    return {
        "irr": F.exp(beta),
        "pct": pct(beta),
        "lo": pct(beta - Z95 * se),
        "hi": pct(beta + Z95 * se),
        "z": F.when(se > 0, beta / se),
    }


def pct_per_10m(beta: Column, sd: Column) -> Column:
    return F.when(sd > 0.05, pct(beta * 10.0 / sd))


def pct_per_sd(beta: Column, sd: Column) -> Column:
    return pct(beta * sd)


def safe_div(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def safe_corr(a: Column, b: Column) -> Column:
    """Pairwise-complete correlation; null (not an error) where a side does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    sd = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(sd > 0, F.covar_pop(x, y) / F.when(sd > 0, sd))


# ---- distribution helpers on result rows ------------------------------------
def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma: series below a+1, continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - scale * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    tiny = 1e-300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + even * d or tiny)
        c = 1 + even / c or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + odd * d or tiny)
        c = 1 + odd / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_cdf_value(x: float, df: float) -> float:
    return _gamma_p(df / 2, x / 2)


def t_cdf_value(t: float, df: float) -> float:
    tail = 0.5 * _beta_i(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t >= 0 else tail


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-15 * max(abs(hi), 1e-300):
            break
    return (lo + hi) / 2


def chi2_ppf_value(p: float, df: float) -> float:
    return _invert(lambda v: chi2_cdf_value(v, df), p, 0.0, max(df, 1.0))


def t_ppf_value(p: float, df: float) -> float:
    if p < 0.5:
        return -t_ppf_value(1 - p, df)
    return _invert(lambda v: t_cdf_value(v, df), p, 0.0, 2.0)


def _batched(value_fn):
    @F.pandas_udf("double")
    def run(a: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([
            value_fn(x, d) if np.isfinite(x) and np.isfinite(d) and d > 0 else None
            for x, d in zip(a.astype(float), df.astype(float))
        ], dtype="float64")
    return run


def t_ppf(p: float, df: Column) -> Column:
    return _batched(t_ppf_value)(F.lit(p), df.cast("double"))


def t_cdf(t: Column, df: Column) -> Column:
    return _batched(t_cdf_value)(t.cast("double"), df.cast("double"))


def chi2_cdf(x: Column, df: Column) -> Column:
    return _batched(chi2_cdf_value)(x.cast("double"), df.cast("double"))


def chi2_ppf(p: float, df: Column) -> Column:
    return _batched(chi2_ppf_value)(F.lit(p), df.cast("double"))
