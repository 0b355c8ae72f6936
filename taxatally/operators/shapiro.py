"""The W test of normality with the weights of order statistics, on globally ranked rows.

Weights follow from expected normal scores, the two outermost on each side by published polynomials
(Royston 1992, 1995), so W needs a few sums over the ranked rows and its four outermost values. The
published p value holds for 3 to 5,000 rows; beyond, the limiting distribution of ``n (1 - W)``
(de Wet and Venter 1972) is used: a weighted sum of chi-square variables, of which the tail is an
integral that doesn't grow with the rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatally.functions.distributions import normal_quantile, normal_upper
from taxatally.operators.ordering import normal_scores

#: Rows up to which the published approximation of p holds.
PUBLISHED = 5000
# Published polynomials in 1 / sqrt(n), lowest power first, for the outermost weights.
_OUTER = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
# Published polynomials for the mean and the log deviation of the transformed statistic.
_SMALL_MEAN, _SMALL_SPREAD = (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN, _LARGE_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _polynomial(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def w_statistic(df: DataFrame, value: str, tie: str) -> tuple[int, float]:
    """Rows and W; W is nan below three rows and for equal values."""
    scores = normal_scores(df, value, tie, offset=0.375)
    n = df.where(F.col(value).isNotNull()).count()
    at = lambda i: F.max(F.when(F.col("idx") == i, F.col("value"))).cast("double")
    m = lambda i: F.max(F.when(F.col("idx") == i, F.col("score")))
    x = F.col("value").cast("double")
    row = scores.agg(
        F.sum(F.col("score") ** 2).alias("mm"), F.sum(F.col("score") * x).alias("mx"), (F.var_pop(x) * n).alias("squares"),
        at(0).alias("x0"), at(1).alias("x1"), at(n - 2).alias("y1"), at(n - 1).alias("y0"), m(n - 1).alias("m0"), m(n - 2).alias("m1"),
    ).first()
    if n < 3 or not row.squares:
        return n, math.nan
    if n == 3:
        return n, 0.5 * (row.y0 - row.x0) ** 2 / row.squares
    u, length = 1 / math.sqrt(n), math.sqrt(row.mm)
    outer = row.m0 / length + _polynomial(_OUTER, u)
    if n > 5:
        second = row.m1 / length + _polynomial(_NEXT, u)
        scale = (row.mm - 2 * row.m0**2 - 2 * row.m1**2) / (1 - 2 * outer**2 - 2 * second**2)
        inner = row.mx - row.m0 * (row.y0 - row.x0) - row.m1 * (row.y1 - row.x1)
        total = outer * (row.y0 - row.x0) + second * (row.y1 - row.x1) + inner / math.sqrt(scale)
    else:
        scale = (row.mm - 2 * row.m0**2) / (1 - 2 * outer**2)
        total = outer * (row.y0 - row.x0) + (row.mx - row.m0 * (row.y0 - row.x0)) / math.sqrt(scale)
    return n, min(total**2 / row.squares, 1.0)


def weighted_chi_square_upper(x: float, weights: np.ndarray, variance: float, steps: int = 4000) -> float:
    """Chance that the sum of ``w (Z^2 - 1)`` and a normal of the given variance exceeds ``x`` (Imhof's integral)."""
    # The integrand dies off with the normal part and with the product over the weights.
    top = 60.0 / max(weights.max(), 1e-12)
    t = (np.arange(steps) + 0.5) * top / steps
    angle = 0.5 * np.arctan(2 * np.outer(t, weights)).sum(axis=1) - t * (weights.sum() + x)
    fall = np.exp(0.25 * np.log1p((2 * np.outer(t, weights)) ** 2).sum(axis=1) + 0.5 * variance * t * t)
    return float(min(max(0.5 + (np.sin(angle) / (t * fall)).sum() * top / steps / math.pi, 0.0), 1.0))


def limit_p(df: DataFrame, n: int, w: float) -> float:
    """P value of W from its limiting distribution; the centring constant is a sum over n ranks."""
    r = (F.col("id") + 1) / (n + 1)
    z = normal_quantile(r)
    ratio = r * (1 - r) * 2 * math.pi * F.exp(z * z)
    centre = df.sparkSession.range(n).agg(F.sum(ratio)).first()[0] / (n + 1) - 1.5
    k = np.arange(3, 400)
    rest = 2 * (math.pi**2 / 6 - float((1 / np.arange(1, 400) ** 2.0).sum()))
    return weighted_chi_square_upper(n * (1 - w) - centre, 1 / k, rest)


def w_p(n: int, w: float) -> float:
    """Published p value for 3 to 5,000 rows."""
    if n == 3:
        return min(1.0, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1:
        return 1.0
    log_n = math.log(n)
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if math.log1p(-w) >= gamma:
            return 0.0
        y, mean, spread = -math.log(gamma - math.log1p(-w)), _polynomial(_SMALL_MEAN, n), math.exp(_polynomial(_SMALL_SPREAD, n))
    else:
        y, mean, spread = math.log1p(-w), _polynomial(_LARGE_MEAN, log_n), math.exp(_polynomial(_LARGE_SPREAD, log_n))
    return normal_upper((y - mean) / spread)


def shapiro(df: DataFrame, value: str, tie: str) -> tuple[int, float, float]:
    """Rows, W and p. Nulls are left out; ``tie`` orders equal values, which changes nothing but the order."""
    n, w = w_statistic(df, value, tie)
    if math.isnan(w):
        return n, w, math.nan
    return n, w, w_p(n, w) if n <= PUBLISHED else limit_p(df, n, w)
