"""The Beta distribution's quantiles, and posteriors of failure rates.

Spark has no Beta quantile, so it is computed in Arrow batches with numpy, and only for the different pairs of counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def ln_gamma(x: np.ndarray | float) -> np.ndarray:
    return _lgamma(np.asarray(x, float))


#: What a further term of the fraction may change, relative to the whole, and still be left out.
SETTLED = 8 * np.finfo(float).eps


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function by the modified Lentz method, for all elements at once;
    an element stops counting when its factor has settled. Where x is at most (a + 1) / (a + b + 2), as here, that takes
    a number of terms of the order of the square root of the larger parameter."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    guard = lambda v: np.where(np.abs(v) < least, least, v)
    d = 1 / guard(1 - (a + b) * x / (a + 1))
    c, out = np.ones_like(x), d.copy()
    live, terms = np.ones(x.shape, bool), 64 + 16 * math.isqrt(int(max(np.max(a, initial=0), np.max(b, initial=0))))
    for m in range(1, terms):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / guard(1 + k * d), guard(1 + k / c)
            step = d * c
            out = np.where(live, out * step, out)
        live &= np.abs(step - 1) > SETTLED
        if not live.any():
            break
    return out


def incomplete_beta(x: np.ndarray | float, a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    """I_x(a, b), the distribution function of Beta(a, b)."""
    x, a, b = (np.atleast_1d(v) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b))))
    inside = (x > 0) & (x < 1)
    y = np.where(inside, x, 0.5)
    front = np.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * np.log(y) + b * np.log1p(-y))
    swap = y > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - y, y)
    part = front * _fraction(z, p, q) / p
    return np.where(inside, np.where(swap, 1 - part, part), np.where(x <= 0, 0.0, 1.0))


def beta_quantile(p: np.ndarray | float, a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    """By bisection of [0, 1] down to neighbouring numbers near 1; 0 and 1 for p at or beyond them."""
    p, a, b = (np.atleast_1d(v) for v in np.broadcast_arrays(*(np.asarray(v, float) for v in (p, a, b))))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(np.finfo(float).nmant + 2):
        mid = (low + high) / 2
        under = incomplete_beta(mid, a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return np.where(p <= 0, 0.0, np.where(p >= 1, 1.0, (low + high) / 2))


def posterior(runs: DataFrame, a0: float = 0.5, b0: float = 0.5, level: float = 0.95) -> DataFrame:
    """runs (with passes, fails) and post_mean, post_low, post_high: the failure rate's mean and equal-tailed interval
    under a Beta(a0, b0) prior. The default is the Jeffreys prior."""
    tail = (1 - level) / 2

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            a, b = x["fails"].to_numpy() + a0, x["passes"].to_numpy() + b0
            yield x.assign(post_low=beta_quantile(tail, a, b), post_high=beta_quantile(1 - tail, a, b))

    pairs = runs.select("passes", "fails").where("passes is not null and fails is not null").distinct()
    known = pairs.mapInPandas(bounds, "passes bigint, fails bigint, post_low double, post_high double")
    n = F.col("passes") + F.col("fails") + (a0 + b0)
    return runs.join(known, ["passes", "fails"], "left").withColumn("post_mean", (F.col("fails") + a0) / n)


def jeffreys(runs: DataFrame, level: float = 0.95) -> DataFrame:
    return posterior(runs, 0.5, 0.5, level)
