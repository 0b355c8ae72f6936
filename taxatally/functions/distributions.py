"""Tail probabilities and quantiles.

Column forms work on whole tables. The plain functions take the handful of test
statistics a report holds, after Spark has reduced the table to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal quantile, published as algorithm
# AS 241 (1988); numerator and denominator of the centre, the shoulders and the tails.
_CENTRE = (
    [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
     4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
    [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3],
)
_SHOULDER = (
    [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
     1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
_TAIL = (
    [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
     2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)


def _horner(x: str, coefficients: list[float]) -> str:
    text = f"{coefficients[-1]:.17e}"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c:.17e})"
    return text


def normal_quantile_sql(p: str) -> str:
    """SQL text of the standard normal quantile of ``p`` (0 < p < 1), in plain arithmetic."""
    q = f"({p} - CAST(0.5 AS DOUBLE))"
    r = f"(CAST(0.180625 AS DOUBLE) - {q} * {q})"
    t = f"sqrt(-ln(least({p}, 1 - {p})))"

    def fraction(x: str, pair: tuple[list[float], list[float]]) -> str:
        return f"{_horner(x, pair[0])} / {_horner(x, pair[1])}"

    side = f"(CASE WHEN {p} < 0.5 THEN -1 ELSE 1 END)"
    shoulder, tail = fraction(f"({t} - 1.6e0)", _SHOULDER), fraction(f"({t} - 5e0)", _TAIL)
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * {fraction(r, _CENTRE)} "
        f"WHEN {t} <= 5 THEN {side} * {shoulder} ELSE {side} * {tail} END"
    )


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile as a column expression."""
    q = p - F.lit(0.5)
    r = F.lit(0.180625) - q * q
    t = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))

    def fraction(x: Column, pair: tuple[list[float], list[float]]) -> Column:
        top, bottom = (F.lit(c[-1]) for c in pair)
        for a, b in zip(reversed(pair[0][:-1]), reversed(pair[1][:-1]), strict=True):
            top, bottom = top * x + F.lit(a), bottom * x + F.lit(b)
        return top / bottom

    side = F.when(p < 0.5, -1.0).otherwise(1.0)
    return (
        F.when(F.abs(q) <= 0.425, q * fraction(r, _CENTRE))
        .when(t <= 5, side * fraction(t - F.lit(1.6), _SHOULDER))
        .otherwise(side * fraction(t - F.lit(5.0), _TAIL))
    )


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_square_upper(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    return _gamma_upper(df / 2, x / 2) if x > 0 else 1.0


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below ``a + 1``, continued fraction above."""
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 100_000):
        step = -i * (i - a)
        b += 2
        d = 1 / _away(step * d + b)
        c = _away(b + step / c)
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def f_upper(x: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    return _beta(df2 / (df2 + df1 * x), df2 / 2, df1 / 2) if x > 0 else 1.0


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(1 - x, b, a) / b
    return front * _beta_fraction(x, a, b) / a


def _beta_fraction(x: float, a: float, b: float) -> float:
    c, d = 1.0, 1 / _away(1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / _away(1 + top * d)
            c = _away(1 + top / c)
            h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return h


def _away(value: float) -> float:
    """Keep a denominator off zero."""
    return value if abs(value) > 1e-300 else 1e-300
