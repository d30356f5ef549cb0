"""Special functions behind the p-values: pure `math`, and Arrow-batched columns of them.

Spark has no erf, gamma or beta tail. The statistics are column expressions;
only these scalar tails, over small aggregate tables, run in Python."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def neg_log10_two_sided(z: float) -> float:
    """-log10 of the two-sided normal p, by Mills' ratio where p underflows."""
    p = normal_two_sided(z)
    if p > _TINY:
        return -math.log10(p)
    a = abs(z)
    return -(math.log(2) - a * a / 2 - math.log(a * math.sqrt(2 * math.pi))) / math.log(10)


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1 / 1e-30, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-30 else 1e-30)
        c = b + an / c
        c = c if abs(c) > 1e-30 else 1e-30
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return 1.0 if df <= 0 or x <= 0 else gamma_q(df / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x >= (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-30 else 1e-30)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-30 else 1e-30)
            c = 1 + num / c
            c = c if abs(c) > 1e-30 else 1e-30
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def student_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def student_sf(t: float, df: float) -> float:
    half = student_two_sided(t, df) / 2
    return half if t > 0 else 1 - half


def kolmogorov_sf(x: float) -> float:
    """P(K > x) of the Kolmogorov distribution."""
    if x <= 0:
        return 1.0
    if x < 0.3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def fisher_combine(ps: list[float]) -> float:
    ps = [max(p, _TINY) for p in ps]
    return chi2_sf(-2 * sum(map(math.log, ps)), 2 * len(ps)) if ps else 1.0


def chi2_median_ratio(df: float) -> float:
    """Median of chi-square over its degrees of freedom (Wilson-Hilferty)."""
    return max(1e-9, 1 - 2 / (9 * df)) ** 3


def dispersion(pairs: list[tuple[float, float]]) -> float:
    """Robust overdispersion of (statistic, df); 1 below three pairs."""
    xs = sorted(s / d / chi2_median_ratio(d) for s, d in pairs if d > 0)
    if len(xs) < 3:
        return 1.0
    n = len(xs)
    return max(1.0, (xs[n // 2] + xs[(n - 1) // 2]) / 2)


def _column(fn, name: str):
    def over(*args: Column) -> Column:
        def batch(*series: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None or v != v for v in row) else fn(*row) for row in zip(*series)], dtype="float64")

        # pandas_udf infers its kind from the number of arguments it is given
        one = lambda a: batch(a)
        two = lambda a, b: batch(a, b)
        f = one if len(args) == 1 else two
        f.__annotations__ = {k: pd.Series for k in ("a", "b")[: len(args)]} | {"return": pd.Series}
        return F.pandas_udf(f, "double")(*args)

    over.__name__ = name
    return over


normal_p = _column(normal_two_sided, "normal_p")
normal_tail = _column(normal_sf, "normal_tail")
score_of_z = _column(neg_log10_two_sided, "score_of_z")
chi2_p = _column(chi2_sf, "chi2_p")
student_p = _column(student_two_sided, "student_p")
student_tail = _column(student_sf, "student_tail")
kolmogorov_p = _column(kolmogorov_sf, "kolmogorov_p")


# -- statistics as column expressions -------------------------------------------------------


def two_proportion_z(k1: Column, n1: Column, k0: Column, n0: Column) -> Column:
    """Pooled z; NULL where the pooled rate is 0 or 1."""
    pooled = (k1 + k0) / (n1 + n0)
    return F.when((pooled > 0) & (pooled < 1), (k1 / n1 - k0 / n0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0)))


def cohens_h(p1: Column, p0: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p0))


def welch_z(m1: Column, v1: Column, n1: Column, m0: Column, v0: Column, n0: Column) -> Column:
    return F.try_divide(m1 - m0, F.sqrt(v1 / n1 + v0 / n0))


def cohens_d(m1: Column, v1: Column, m0: Column, v0: Column) -> Column:
    return F.try_divide(m1 - m0, F.sqrt((v1 + v0) / 2))


def prediction_t(x: Column, mean: Column, sd: Column, k: Column) -> Column:
    """t of a new value against k earlier ones; needs k >= 2."""
    s = F.greatest(sd, 1e-9 * F.abs(mean), F.lit(1e-12))
    return F.when(k >= 2, (x - mean) / (s * F.sqrt(1 + 1 / k)))


def fisher_z(r1: Column, n1: Column, r0: Column, n0: Column) -> Column:
    clip = lambda r: F.greatest(F.least(r, F.lit(0.999999)), F.lit(-0.999999))
    return (F.atanh(clip(r1)) - F.atanh(clip(r0))) / F.sqrt(1 / (n1 - 3) + 1 / (n0 - 3))


def half_life(age: Column, half: float) -> Column:
    """0.5 ** (age / half); the future counts as now."""
    return F.when(age <= 0, 1.0).otherwise(F.pow(F.lit(0.5), age / half))
