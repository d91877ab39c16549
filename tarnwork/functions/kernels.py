"""Distribution functions in NumPy, for Arrow UDFs: there is no SciPy here."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)
_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) by Gauss-Legendre quadrature of cos(x)^(df-1) from atan(|t| / sqrt(df)) to pi / 2."""
    t, df = np.broadcast_arrays(np.abs(np.asarray(t, float)), np.asarray(df, float))
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    out = np.full(t.shape, np.nan)
    low = np.arctan2(t[ok], np.sqrt(df[ok]))
    d = df[ok]
    # cos^(d-1) lives within some 12 / sqrt(d) of its largest value at the lower end
    span = np.minimum(np.pi / 2 - low, np.where(d > 2, np.maximum(40.0 / np.maximum((d - 1) * np.tan(low), np.sqrt(d)), 1e-12), np.pi))
    x = low[:, None] + span[:, None] * (_NODES + 1) / 2
    c = np.log(np.maximum(np.cos(x), 1e-300))
    logs = (d[:, None] - 1) * c
    top = logs.max(axis=1)
    area = (np.exp(logs - top[:, None]) @ _WEIGHTS) * span / 2
    out[ok] = np.minimum(1.0, 2 / math.sqrt(math.pi) * np.exp(_LGAMMA((d + 1) / 2) - _LGAMMA(d / 2) + top) * area)
    return out


def student_quantile(p: float, df: np.ndarray) -> np.ndarray:
    """The t with P(T <= t) = p for p above one half, by bisection on 0..50 widened as needed."""
    df = np.asarray(df, float)
    low, high = np.zeros(df.shape), np.full(df.shape, 1e6)
    for _ in range(80):
        middle = (low + high) / 2
        above = 1 - student_two_sided(middle, df) / 2 > p
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return np.where(np.isfinite(df) & (df > 0), (low + high) / 2, np.nan)


#: fixed values: the Bernoulli numbers B2, B4, ... B14
_BERNOULLI = np.array([1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6])
_K = 2 * np.arange(1, len(_BERNOULLI) + 1)
_BELOW = np.arange(16)  # terms taken off before the series for large arguments is used


def polygamma(order: int, x: np.ndarray) -> np.ndarray:
    """digamma (order 0), trigamma (1) or tetragamma (2) of x > 0, for whole arrays: 16 terms of the recurrence at once, then
    the asymptotic series at x + 16, whose next term is below 1e-16."""
    x = np.asarray(x, float)
    near = x[..., None] + _BELOW
    z = x + len(_BELOW)
    powers = z[..., None] ** -_K
    if order == 0:
        return np.log(z) - 1 / (2 * z) - powers @ (_BERNOULLI / _K) - (1 / near).sum(-1)
    if order == 1:
        return 1 / z + 1 / (2 * z**2) + powers @ _BERNOULLI / z + (1 / near**2).sum(-1)
    return -1 / z**2 - 1 / z**3 - powers @ (_BERNOULLI * (_K + 1)) / z**2 - 2 * (1 / near**3).sum(-1)


def digamma(x: float) -> float:
    return float(polygamma(0, x))


def trigamma(x: float) -> float:
    return float(polygamma(1, x))


def trigamma_inverse(y: np.ndarray) -> np.ndarray:
    """The x with trigamma(x) = y > 0: Newton's steps on 1 / trigamma, which is nearly a straight line, from 1/2 + 1 / y."""
    y = np.asarray(y, float)
    x = 0.5 + 1 / y
    for _ in range(60):
        value = polygamma(1, x)
        step = value * (1 - value / y) / polygamma(2, x)
        x = x + step
        if np.all(np.abs(step) <= 1e-14 * x):
            break
    return x


def student_p(t: Column, df: Column) -> Column:
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(student_two_sided(t.to_numpy(float), df.to_numpy(float))).replace({np.nan: None}).astype(float)

    return F.nanvl(F.pandas_udf(run, "double")(t, df), F.lit(None).cast("double"))


def student_t(level: float, df: Column) -> Column:
    """The half width, in standard errors, of a two-sided interval of the level."""

    def run(df: pd.Series) -> pd.Series:
        values, at = np.unique(df.to_numpy(float), return_inverse=True)
        return pd.Series(student_quantile((1 + level) / 2, values)[at])

    return F.pandas_udf(run, "double")(df)
