"""Numbers that several operators need."""

from __future__ import annotations

import math

import numpy as np

_EXACT = np.array([math.lgamma(i + 1) for i in range(32)])


def log_factorial(k: np.ndarray) -> np.ndarray:
    """Log of k! by Stirling's series, from a table below 32."""
    z = np.maximum(k, 31) + 1.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return np.where(np.asarray(k) < 32, _EXACT[np.minimum(k, 31).astype(int)], series)


def harmonic(k: np.ndarray) -> np.ndarray:
    """Sum of 1 / i for i up to k, by its asymptotic series from a table below 32."""
    z = np.maximum(k, 31).astype(float)
    series = np.log(z) + 0.5772156649015329 + 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)
    table = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, 32))])
    return np.where(np.asarray(k) < 32, table[np.minimum(k, 31).astype(int)], series)


def chance_of_none(n: int, x: np.ndarray, m: int, walked: int = 4096) -> np.ndarray:
    """Chance that of n things of which x are marked m drawn ones hold no marked one.

    It is the product of (n - m - j) / (n - j) for j below x, multiplied out for x up to ``walked``; beyond it the
    logarithm comes from Stirling's series, arranged so that what cancels is of the size of x and not of n log n.
    """
    x = np.asarray(x, np.int64)
    if m >= n:
        return (x == 0).astype(float)
    j = np.arange(min(int(x.max(initial=0)), walked))
    product = np.concatenate([[1.0], np.cumprod(np.maximum(n - m - j, 0) / (n - j))])
    out = product[np.minimum(x, len(product) - 1)]
    far = np.nonzero(x > walked)[0]
    if len(far):
        y, rest = x[far].astype(float), float(n - m)
        left = rest - y  # neither marked nor drawn
        near_end = left < 32
        with np.errstate(divide="ignore", invalid="ignore"):
            log = y * math.log1p(-m / n) - (left + 0.5) * np.log1p(-y / rest) + (n - y + 0.5) * np.log1p(-y / n)
            log += (1 / rest - 1 / left - 1 / n + 1 / (n - y)) / 12
        ends = log_factorial(np.float64(rest)) - log_factorial(np.maximum(left, 0)) - log_factorial(np.float64(n)) + log_factorial(n - y)
        out = out.copy()
        out[far] = np.where(left < 0, 0.0, np.exp(np.where(near_end, ends, log)))
    return out
