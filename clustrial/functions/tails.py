"""Tails of the t and F distributions on arrays.

Spark has no incomplete beta function. These run on one value per coefficient or
per model, never on data rows.
"""

from __future__ import annotations

import math

import numpy as np


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    # The fraction converges fast only left of the mean; mirror the rest.
    mirrored = x > (a + 1) / (a + b + 2)
    p, q = np.where(mirrored, b, a), np.where(mirrored, a, b)
    z = np.clip(np.where(mirrored, 1 - x, x), 0.0, 1.0)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.exp(
            _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)
        )
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c = np.ones_like(z)
    fraction = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            fraction = fraction * step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    value = np.where(z <= 0, 0.0, scale * fraction / p)
    return np.where(mirrored, 1 - value, value)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2, np.full_like(df, 0.5), df / (df + t * t))


def f_upper(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f, df1, df2 = (np.asarray(v, dtype=float) for v in (f, df1, df2))
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def t_quantile(level: float, df: np.ndarray) -> np.ndarray:
    """The t with ``level`` of the distribution between -t and t.

    That share is concave in t, so Newton steps from 0 approach it from the left.
    """
    df = np.asarray(df, dtype=float)
    peak = np.exp(_log_gamma((df + 1) / 2) - _log_gamma(df / 2)) / np.sqrt(df * math.pi)
    t = np.zeros_like(df)
    for _ in range(200):
        density = peak * (1 + t * t / df) ** (-(df + 1) / 2)
        step = (level - (1 - t_two_sided(t, df))) / (2 * density)
        t = t + step
        if np.all(np.abs(step) <= 1e-12 * np.maximum(t, 1)):
            break
    return t
