"""Closed-form statistics as Column expressions: normal quantiles, Wilson intervals, rerun budgets, verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The level at which rerun counts are reported, whatever the level of the intervals.
REPRODUCE = 0.95

# Acklam's rational approximation of the normal quantile, and where its tails begin.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL = 0.02425


def _poly(coefficients, x):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_ppf(p: float) -> float:
    """The standard normal quantile; infinite at and beyond 0 and 1."""
    if p <= 0:
        return -math.inf
    if p >= 1:
        return math.inf
    if _TAIL <= p <= 1 - _TAIL:
        r = (p - 0.5) ** 2
        return (p - 0.5) * _poly(_A, r) / _poly(_B, r)
    q = math.sqrt(-2 * math.log(min(p, 1 - p)))
    return _poly(_C, q) / _poly(_D, q) * (1 if p < 0.5 else -1)


def normal_ppf_column(p: Column) -> Column:
    r, q = (p - 0.5) * (p - 0.5), F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _poly(_C, q) / _poly(_D, q)
    return F.when(p <= 0, F.lit(-math.inf)).when(p >= 1, F.lit(math.inf)).when(p < _TAIL, tail).when(p > 1 - _TAIL, -tail).otherwise((p - 0.5) * _poly(_A, r) / _poly(_B, r))


def z_critical(level: float) -> float:
    return normal_ppf(1 - (1 - level) / 2)


def wilson(successes: Column, n: Column, level: float = REPRODUCE) -> Column:
    """struct<estimate, low, high, level>: the Wilson score interval, within [0, 1]; (0, 0, 1) without observations.
    At level 1 the interval is all of [0, 1]."""
    z = z_critical(level)
    m = F.when(n > 0, n.cast("double"))
    p = successes / m
    if math.isinf(z):
        low, high = F.lit(0.0), F.lit(1.0)
    else:
        z2 = z * z
        center = (p + z2 / (2 * m)) / (1 + z2 / m)
        half = z / (1 + z2 / m) * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m))
        low, high = F.greatest(center - half, F.lit(0.0)), F.least(center + half, F.lit(1.0))
    known = n > 0
    return F.struct(F.coalesce(p, F.lit(0.0)).alias("estimate"), F.when(known, low).otherwise(0.0).alias("low"), F.when(known, high).otherwise(1.0).alias("high"), F.lit(float(level)).alias("level"))


def margin(interval: Column) -> Column:
    return (interval["high"] - interval["low"]) / 2


def total(passes: Column, fails: Column) -> Column:
    return passes + fails


def verdict(passes: Column, fails: Column) -> Column:
    return F.when((passes == 0) & (fails == 0), "unknown").when(fails == 0, "stable_pass").when(passes == 0, "stable_fail").otherwise("flaky")


def required_reruns(p: Column, confidence: Column | float = REPRODUCE) -> Column:
    """Runs after which a failure of rate p has shown with the given confidence; null where it never fails."""
    g = F.least(F.greatest(confidence if isinstance(confidence, Column) else F.lit(float(confidence)), F.lit(0.0)), F.lit(0.999999))
    below = F.log(1 - p)
    n = F.when(below < 0, F.ceil(F.log(1 - g) / F.when(below < 0, below)))
    return F.when(p <= 0, F.lit(None)).when(p >= 1, F.lit(1)).otherwise(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))).cast("bigint")


def reruns(p: float, confidence: float = REPRODUCE) -> int | None:
    """required_reruns of numbers."""
    if p <= 0:
        return None
    if p >= 1:
        return 1
    below = math.log(1 - p)
    return max(1, math.ceil(math.log(1 - min(max(confidence, 0.0), 0.999999)) / below)) if below < 0 else 1


def unit_interval(value: float) -> float:
    """value, if it lies in [0, 1]; ValueError otherwise, also for NaN."""
    if not 0 <= value <= 1:
        raise ValueError(f"{value} is not in [0, 1]")
    return value


def within_unit(value: Column) -> Column:
    """The value where it lies in [0, 1]; null otherwise, also for NaN."""
    return F.when((value >= 0) & (value <= 1), value)
