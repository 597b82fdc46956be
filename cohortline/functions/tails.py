"""Two-sided tail probabilities of t, normal and chi-square statistics.

They are needed on finished result tables; one Arrow-batched UDF works on whole arrays. All three
are incomplete beta or gamma functions, for any positive degrees of freedom.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lanczos coefficients (g = 7) of the gamma function.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
STEPS = 20_000


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For positive ``x``; small ones by the next value."""
    z = x - 1 + (x < 0.5)
    total = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(total) - np.where(x < 0.5, np.log(x), 0.0)


def _fraction(first: np.ndarray, term) -> np.ndarray:
    """A continued fraction ``first + a1 / (b1 + a2 / (b2 + ...))`` with ``term(i) = (a, b)``, from the front."""
    tiny = 1e-300
    value = np.where(first == 0, tiny, first)
    c, d = value, np.zeros_like(value)
    for i in range(1, STEPS):
        a, b = term(i)
        d = b + a * d
        d = 1 / np.where(d == 0, tiny, d)
        c = b + a / c
        c = np.where(c == 0, tiny, c)
        value = value * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return value


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function."""
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b)) / a

    def term(i):
        if i == 1:
            return np.ones_like(x), np.ones_like(x)
        m = (i - 1) // 2
        if i % 2:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), np.ones_like(x)
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), np.ones_like(x)

    share = front * _fraction(np.zeros_like(x), term)
    return np.where(swap, 1 - share, share)


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The upper regularised incomplete gamma function."""
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(a * np.log(x) - x - _log_gamma(a))
    near = x < a + 1
    low = np.where(near, x, 0.0)
    term = total = 1 / a
    for n in range(1, STEPS):
        term = term * low / (a + n)
        total = total + term
        if np.all(term <= total * 1e-17):
            break
    high = np.where(near, a + 2, x)
    tail = _fraction(np.zeros_like(high), lambda i: (np.ones_like(high) if i == 1 else -(i - 1) * (i - 1 - a), high + 2 * i - 1 - a))
    return np.where(x <= 0, 1.0, np.where(near, 1 - front * total, front * tail))


def tails(stat: np.ndarray, df: np.ndarray, dist: str) -> np.ndarray:
    """p values; NaN where the statistic, or the degrees of freedom it needs, are missing or out of range."""
    good = ~np.isnan(stat)
    if dist != "normal":
        good &= df > 0
    if dist == "chi2":
        good &= stat >= 0
    s, k = stat[good], df[good]
    out = np.full(len(stat), np.nan)
    if dist == "normal":
        out[good] = gamma_tail(np.full(len(s), 0.5), s * s / 2)
    elif dist == "t":
        out[good] = beta_share(k / 2, np.full(len(s), 0.5), k / (k + s * s))
    else:
        out[good] = gamma_tail(k / 2, s / 2)
    return np.clip(out, 0.0, 1.0)


def p_value(stat: str | Column, dist: str = "normal", df: str | Column | None = None) -> Column:
    """p value column; ``dist`` is ``t``, ``normal`` (both two-sided) or ``chi2`` (upper tail)."""
    if dist not in ("t", "normal", "chi2"):
        raise ValueError(f"unknown distribution {dist}")

    @F.pandas_udf(T.DoubleType())
    def tail(s: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(tails(s.to_numpy(dtype=float), d.to_numpy(dtype=float), dist))

    s = F.col(stat) if isinstance(stat, str) else stat
    d = F.lit(None) if df is None else (F.col(df) if isinstance(df, str) else df)
    out = tail(s.cast("double"), d.cast("double"))
    return F.when(~F.isnan(out), out)


def with_p_value(table: DataFrame, stat: str, dist: str = "normal", df: str | None = None,
                 name: str = "p") -> DataFrame:
    return table.withColumn(name, p_value(stat, dist, df))
