"""Queries on models with random levels: likelihood, fit, deletion, explained variance, contrasts, curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from taxatally.functions.distributions import normal_quantile_sql
from taxatally.operators import contrasts, describe, glm, laplace, rank_tests, shapiro
from taxatally.operators.glm import Numeric
from taxatally.operators.reshape import prediction_grid
from taxatally.plans.registry import Tables, query
from taxatally.plans.stat_queries import _DET, FLAG, KIND, NEWTON, frame, rounded
from taxatally.plans.views import FRAME
from taxatally.session import small_table, stored

#: Fixed effects and variances at which the likelihood is asked for.
POINTS = [(-0.1, 0.2, 0.05, 0.05), (0.1, -0.3, 0.4, 0.5), (0.0, 0.0, 0.0, 3.0)]
LEVELS = ["region", "nation"]


def _values(points) -> str:
    return ", ".join("(" + ", ".join([str(i), *(f"{x}::DOUBLE" for x in p)]) + ")" for i, p in enumerate(points))


# Modes of all nations by 40 Newton steps each, then the sums of the approximation at the modes.
_ETA = "b0 + b1 * CAST(flag = 'N' AS INT) + b2 * CAST(flag = 'R' AS INT) + u"


@query("m2_laplace_likelihood", f"""WITH RECURSIVE points(point, b0, b1, b2, v) AS (VALUES {_values(POINTS)}),
cells AS (SELECT nation, flag, COUNT(*) AS n, SUM(y) AS sy FROM ({FRAME}) GROUP BY 1, 2),
steps(k, point, nation, u) AS (SELECT 0, point, nation, CAST(0 AS DOUBLE) FROM points, (SELECT DISTINCT nation FROM cells) UNION ALL
  SELECT k + 1, point, nation, u + (SUM(sy - n * mu) - u / v) / (SUM(n * mu * (1 - mu)) + 1 / v)
  FROM (SELECT k, point, nation, u, v, n, sy, 1 / (1 + exp(-({_ETA}))) AS mu FROM steps JOIN points USING (point) JOIN cells USING (nation) WHERE k < 40) GROUP BY k, point, nation, u, v),
per AS (SELECT point, nation, u, v, SUM(sy * eta - n * (greatest(eta, 0) + ln(1 + exp(-abs(eta))))) AS ll, SUM(n * mu * (1 - mu)) AS w
  FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (SELECT point, nation, u, v, n, sy, {_ETA} AS eta FROM steps JOIN points USING (point) JOIN cells USING (nation) WHERE k = 40)) GROUP BY point, nation, u, v)
SELECT point, ROUND(SUM(ll - u * u / v / 2 - ln(w * v + 1) / 2), 4) AS log_likelihood FROM per GROUP BY 1""")
def _(t: Tables):
    cells = stored(glm.patterns(frame(t), "y", [FLAG], ["nation"]), "patterns")
    likelihood = laplace.Likelihood(cells, [FLAG], ["nation"])
    rows = [(i, round(likelihood.at(np.array(p[:3]), [p[3]]).value, 4)) for i, p in enumerate(POINTS)]
    return small_table(t.spark, "point int, log_likelihood double", rows)


def _mixed(t: Tables, terms):
    return laplace.fit_laplace(frame(t), "y", terms, LEVELS)


@query("m2_laplace_fit")
def _(t: Tables):
    fit = _mixed(t, [FLAG])
    rows = [(n, e, s) for n, e, s, _, _ in fit.rows()] + [(f"variance {k}", v, None) for k, v in fit.random_variance.items()] + [("log likelihood", fit.log_likelihood, None)]
    return small_table(t.spark, "term string, estimate double, std_error double, converged int", [(*r, int(fit.converged)) for r in rows])


@query("m4_mixed_deletion_test")
def _(t: Tables):
    return glm.deletion_tests(frame(t), "y", [FLAG], lambda cells, terms: laplace.fit_laplace_patterns(cells, terms, LEVELS), LEVELS)


@query("m5_mixed_r_squared")
def _(t: Tables):
    marginal, conditional = glm.r_squared(_mixed(t, [KIND]))
    return small_table(t.spark, "marginal double, conditional double", [[marginal, conditional]])


# The estimates have SQL; the adjusted p values are tested against the distribution of the range.
@query("m6_single_step", f"""WITH f AS ({FRAME}), m AS (SELECT kind, ln(AVG(y)) - ln(1 - AVG(y)) AS eta, 1 / (COUNT(*) * AVG(y) * (1 - AVG(y))) AS v FROM f GROUP BY 1)
SELECT b.kind AS level, a.kind AS reference, ROUND(b.eta - a.eta, 6) AS estimate, ROUND(sqrt(a.v + b.v), 6) AS std_error, ROUND((b.eta - a.eta) / sqrt(a.v + b.v), 5) AS z,
CAST(1 AS INT) AS p_in_bounds FROM m a JOIN m b ON a.kind < b.kind""")
def _(t: Tables):
    rows = contrasts.compare_levels(t.spark, glm.fit_glm(frame(t), "y", [KIND]), "kind")
    inside = F.col("p_single_step").between(0, 1) & (F.col("p_single_step") <= F.col("p_sidak") + F.col("p_error") + 1e-3)
    return rounded(rows, 6, "estimate", "std_error").select("level", "reference", "estimate", "std_error", F.round("z", 5).alias("z"), inside.cast("int").alias("p_in_bounds"))


@query("m6_mixed_single_step")
def _(t: Tables):
    return contrasts.compare_levels(t.spark, _mixed(t, [KIND]), "kind")


_V = f"""(d * f - e * e) / {_DET} AS v00, (c * e - b * f) / {_DET} AS v01, (b * e - c * d) / {_DET} AS v02, (a * f - c * c) / {_DET} AS v11, (b * c - a * e) / {_DET} AS v12, (a * d - b * b) / {_DET} AS v22"""


@query("m12_prediction_curve", f"""{NEWTON}, v AS (SELECT b0, b1, b2, {_V} FROM last), ends AS (SELECT MIN(quantity) AS low, MAX(quantity) AS high FROM rows),
grid AS (SELECT low + (high - low) * q.i / 499 AS quantity, CAST(0.08 AS DOUBLE) * x.j / 499 AS tax FROM ends, range(500) q(i), range(500) x(j)),
p AS (SELECT quantity, 1 / (1 + exp(-(b0 + b1 * quantity + b2 * tax))) AS fit, sqrt(v00 + quantity * quantity * v11 + tax * tax * v22 + 2 * (quantity * v01 + tax * v02 + quantity * tax * v12)) AS spread FROM grid, v)
SELECT ROUND(quantity, 6) AS quantity, ROUND(AVG(fit), 6) AS fit, ROUND(AVG(fit - 1.96 * fit * (1 - fit) * spread), 6) AS lower, ROUND(AVG(fit + 1.96 * fit * (1 - fit) * spread), 6) AS upper FROM p GROUP BY 1""")
def _(t: Tables):
    """A numeric sequence over the data's range by another one, scored and collapsed to one curve."""
    rows = frame(t)
    fit = glm.fit_glm(rows, "y", [Numeric("quantity"), Numeric("tax")])
    low, high = rows.agg(F.min("quantity"), F.max("quantity")).first()
    grid = prediction_grid(t.spark, {}, {"quantity": (low, high), "tax": (0.0, 0.08)}, 500)
    curve = describe.collapse_predictions(glm.predict(grid, fit).withColumn("quantity", F.round("quantity", 6)), "quantity", ["fit", "lower", "upper"])
    return rounded(curve, 6, "fit", "lower", "upper")


# ---------------------------------------------------------------- normality
_Z = "(value - 60) / 80"
_CDF = """CASE WHEN z > 7 THEN 1.0 WHEN z < -7 THEN 0.0 ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) *
list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))) END"""


@query("m14_scaled_against_normal", f"""WITH s AS (SELECT {_Z} AS z, row_number() OVER (ORDER BY value) AS i, COUNT(*) OVER () AS n FROM {{events}} WHERE value IS NOT NULL),
c AS (SELECT i, n, {_CDF} AS p FROM s) SELECT ROUND(MAX(greatest(i / n - p, p - (i - 1) / n)), 8) AS statistic FROM c""")
def _(t: Tables):
    """The normal distribution function by its series, in SQL."""
    return rank_tests.against_standard_normal(t.events.selectExpr(f"{_Z} AS z"), "z").select(F.round("statistic", 8).alias("statistic"))


_WEIGHT = """w AS (SELECT n, u, mm, m0, m1, x0, x1, y0, y1, mx, squares, m0 / sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5 AS a0,
m1 / sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3 + 5.682633 * u ** 4 - 3.582633 * u ** 5 AS a1 FROM k)"""


@query("m13_w_test", f"""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) AS i, COUNT(*) OVER () AS n FROM {{events}}),
r AS (SELECT value, i, n, (i - CAST(0.375 AS DOUBLE)) / (n + CAST(0.25 AS DOUBLE)) AS p FROM s), q AS (SELECT value, i, n, {normal_quantile_sql('p')} AS m FROM r),
k AS (SELECT ANY_VALUE(n) AS n, 1 / sqrt(ANY_VALUE(n)) AS u, SUM(m * m) AS mm, SUM(m * value) AS mx, var_pop(value) * ANY_VALUE(n) AS squares, MAX(m) AS m0, MAX(m) FILTER (WHERE i = n - 1) AS m1,
  MIN(value) AS x0, MAX(value) FILTER (WHERE i = 2) AS x1, MAX(value) AS y0, MAX(value) FILTER (WHERE i = n - 1) AS y1 FROM q), {_WEIGHT}
SELECT CAST(n AS BIGINT) AS n, ROUND((a0 * (y0 - x0) + a1 * (y1 - x1) + (mx - m0 * (y0 - x0) - m1 * (y1 - x1)) / sqrt((mm - 2 * m0 ** 2 - 2 * m1 ** 2) / (1 - 2 * a0 ** 2 - 2 * a1 ** 2))) ** 2 / squares, 8) AS w FROM w""")
def _(t: Tables):
    n, w = shapiro.w_statistic(t.events, "value", "event_id")
    return small_table(t.spark, "n bigint, w double", [[n, round(w, 8)]])
