"""Tail probabilities by numpy and the standard library, and pandas UDFs around them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NORMAL = NormalDist()


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(min(max(p, 1e-12), 1 - 1e-12))


def _grid(df: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights of the density of sqrt(chi2 / df)."""
    s = np.linspace(1e-9, 1 + 12 / math.sqrt(2 * df), 4001)
    log = (df - 1) * np.log(s) - df * s * s / 2
    density = np.exp(log - log.max())
    return s, density / density.sum()


def student_sf(t: float, df: int) -> float:
    """P(T > t) by averaging the normal tail over the scale."""
    s, w = _grid(df)
    return float((w * np.array([normal_sf(t * x) for x in s])).sum())


def chi2_sf(x: float, df: int) -> float:
    """Upper tail by the closed series for whole degrees of freedom."""
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return math.exp(-x / 2) * total
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return total


def power_paired_t(d_z: float, n: int, alpha: float) -> float:
    """Power of a one-sided paired t test: the noncentral t tail by averaging over the scale."""
    if n < 2:
        return math.nan
    low, high = 0.0, 60.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if student_sf(middle, n - 1) > alpha else (low, middle)
    s, w = _grid(n - 1)
    return float((w * np.array([normal_sf(low * x - d_z * math.sqrt(n)) for x in s])).sum())


def least_effect(n: int, alpha: float, power: float = 0.8) -> float:
    """The least effect that such a test finds with ``power``."""
    low, high = 0.0, 3.0
    for _ in range(30):
        middle = (low + high) / 2
        low, high = (middle, high) if power_paired_t(middle, n, alpha) < power else (low, middle)
    return high


def signed_rank_exact_sf(w: float, n: int) -> float:
    """P(W+ >= w) without ties, by counting the subsets of the ranks."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for r in range(1, n + 1):
        counts[r:] = counts[r:] + counts[:-r].copy()
    return float(counts[math.ceil(w) :].sum() / 2**n)


def rank_sum_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, by the coefficients of the Gaussian binomial of n1 + n2 over n1."""
    small, large = min(n1, n2), max(n1, n2)
    counts = np.zeros(small * large + 1)
    counts[0] = 1
    for i in range(1, small + 1):
        step = large + i
        if step <= small * large:
            counts[step:] -= counts[:-step].copy()
        for at in range(i, len(counts)):
            counts[at] += counts[at - i]
    return float(counts[max(0, math.ceil(u)) :].sum() / counts.sum())


def shapiro_w(values: np.ndarray, times: np.ndarray) -> tuple[float | None, float | None]:
    """W and p of sorted different ``values`` that are there ``times`` often, by Royston's approximation (1995)."""
    n = int(times.sum())
    mean = float((values * times).sum() / max(n, 1))
    spread = float((times * (values - mean) ** 2).sum())
    if n < 3 or spread == 0:
        return None, None
    ends = np.cumsum(times)
    half = math.sqrt(0.5)
    if n == 3:
        b = half * float(values[-1] - values[0])
    else:
        ranks = np.arange(1, n + 1)
        m = np.array([_NORMAL.inv_cdf(x) for x in (ranks - 0.375) / (n + 0.25)])
        u, total = 1 / math.sqrt(n), float(m @ m)
        last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(total)], u)
        a = m.copy()
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(total)], u)
            phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a /= math.sqrt(phi)
            a[-2], a[1] = second, -second
        else:
            a /= math.sqrt((total - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[-1], a[0] = last, -last
        sums = np.r_[0.0, np.cumsum(a)]
        b = float(((sums[ends] - sums[ends - times]) * values).sum())
    w = min(1.0, b * b / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    log = math.log(n)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        y = gamma - math.log(1 - w) if w < 1 else math.inf
        if y <= 0:
            return w, 0.0
        z = (-math.log(y) - np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)) / math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)) if w < 1 else -math.inf
    else:
        z = (math.log(1 - w) - np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log)) / math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log)) if w < 1 else -math.inf
    return w, normal_sf(float(z))


def shapiro_rows(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
    counts = counts.sort_values("value")
    w, p = shapiro_w(counts["value"].to_numpy(float), counts["t"].to_numpy(int))
    return pd.DataFrame({"name": [key[0]], "n": [int(counts["t"].sum())], "w": [w], "p": [p]})


def _of(f):
    """A pandas UDF of a function of numbers; null where one of them is missing."""

    @F.pandas_udf(T.DoubleType())
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else f(float(x), int(y)) for x, y in zip(a, b)], dtype="float64")

    return column


#: P(W+ >= w), the tail of Student's t and of chi square, as functions of columns.
signed_rank_of = _of(lambda w, n: signed_rank_exact_sf(w, n) if n <= 1000 else math.nan)
student_sf_of = _of(lambda t, df: student_sf(t, df) if df > 0 else math.nan)
chi2_sf_of = _of(lambda x, df: chi2_sf(x, df) if df > 0 else math.nan)


@F.pandas_udf(T.DoubleType())
def rank_sum_of(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    small = [not (pd.isna(x) or pd.isna(a) or pd.isna(b)) and a * b <= 100_000 for x, a, b in zip(u, n1, n2)]
    return pd.Series([rank_sum_exact_sf(float(x), int(a), int(b)) if ok else None for x, a, b, ok in zip(u, n1, n2, small)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_sf_of(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else normal_sf(x))


@F.pandas_udf(T.DoubleType())
def power_of(d_z: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(d) or m < 2 else power_paired_t(abs(d), int(m), a) for d, m, a in zip(d_z, n, alpha)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def least_effect_of(n: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([None if m < 2 else least_effect(int(m), a) for m, a in zip(n, alpha)], dtype="float64")
