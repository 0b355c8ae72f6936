"""Queries on numeric columns and model frames: description, order, tests, models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatally.functions.distributions import normal_quantile_sql
from taxatally.operators import describe, diagnostics, glm, glmm, ordering, rank_tests
from taxatally.operators.glm import Factor, Nested, Numeric
from taxatally.operators.reshape import prediction_grid
from taxatally.plans.registry import Tables, query
from taxatally.plans.views import FRAME
from taxatally.session import small_table

FLAG = Factor("flag", ("A", "N", "R"))
KIND = Factor("kind", ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
PREDICTED = "CAST(0.05 AS DOUBLE) + CAST(0.9 AS DOUBLE) * quantity / 51"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def frame(t: Tables) -> DataFrame:
    return t.sql(FRAME)


def scored(t: Tables) -> DataFrame:
    return frame(t).withColumn("fitted", F.expr(PREDICTED))


SCORED = f"WITH s AS (SELECT *, {PREDICTED} AS fitted FROM ({FRAME}))"


# ---------------------------------------------------------------- description
@query("a17_collapse_predictions", """SELECT l_quantity AS x, ROUND(AVG(l_discount), 8) AS fit, ROUND(AVG(l_tax), 8) AS lower,
ROUND(AVG(l_discount + l_tax), 8) AS upper FROM {lineitem} GROUP BY 1""")
def _(t):
    df = t.lineitem.select(F.col("l_quantity").alias("x"), F.col("l_discount").alias("fit"), F.col("l_tax").alias("lower"), (F.col("l_discount") + F.col("l_tax")).alias("upper"))
    return rounded(describe.collapse_predictions(df, "x", ["fit", "lower", "upper"]), 8, "fit", "lower", "upper")


@query("a18_describe", """SELECT COUNT(value) AS n, MIN(value) AS minimum, MAX(value) AS maximum, ROUND(MAX(value) - MIN(value), 6) AS value_range,
ROUND(quantile_cont(value, 0.25), 6) AS q25, ROUND(quantile_cont(value, 0.5), 6) AS median, ROUND(quantile_cont(value, 0.75), 6) AS q75,
ROUND(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, ROUND(quantile_cont(value, 0.05), 6) AS q5,
ROUND(quantile_cont(value, 0.95), 6) AS q95, ROUND(AVG(value), 6) AS mean, ROUND(var_samp(value), 6) AS variance, ROUND(stddev_samp(value), 6) AS sd FROM {events}""")
def _(t):
    return rounded(describe.describe(t.events, "value"), 6, "value_range", "q25", "median", "q75", "iqr", "q5", "q95", "mean", "variance", "sd")


@query("a18_extreme_rows", """SELECT l_orderkey, l_linenumber, l_quantity, 'highest' AS side FROM {lineitem} WHERE l_quantity = (SELECT MAX(l_quantity) FROM {lineitem})
UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, 'lowest' FROM {lineitem} WHERE l_quantity = (SELECT MIN(l_quantity) FROM {lineitem})""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    high = describe.extreme_rows(df, "l_quantity").withColumn("side", F.lit("highest"))
    return high.unionByName(describe.extreme_rows(df, "l_quantity", highest=False).withColumn("side", F.lit("lowest")))


def _profile_sql() -> str:
    cols = [("o_orderkey", "bigint", 1), ("o_custkey", "bigint", 1), ("o_orderstatus", "string", 0), ("o_totalprice", "double", 1),
            ("o_orderdate", "timestamp", 0), ("o_orderpriority", "string", 0)]
    parts = []
    for name, kind, number in cols:
        nums = f"MIN({name})::DOUBLE, ROUND(AVG({name})::DOUBLE, 4), MAX({name})::DOUBLE, " + ", ".join(f"quantile_cont({name}, {q})::DOUBLE" for q in (0.25, 0.5, 0.75)) if number else ", ".join(["NULL::DOUBLE"] * 6)
        parts.append(f"SELECT '{name}', '{kind}', COUNT(*) - COUNT({name}), COUNT(DISTINCT {name}), {nums} FROM {{orders}}")
    first = parts[0].replace("'o_orderkey',", "'o_orderkey' AS column_name,").replace("'bigint',", "'bigint' AS type,", 1)
    first = first.replace("COUNT(o_orderkey), ", "COUNT(o_orderkey) AS nulls, ", 1).replace("COUNT(DISTINCT o_orderkey),", "COUNT(DISTINCT o_orderkey) AS distinct_values,")
    first = first.replace("MIN(o_orderkey)::DOUBLE,", "MIN(o_orderkey)::DOUBLE AS minimum,").replace("::DOUBLE, 4),", "::DOUBLE, 4) AS mean,").replace("MAX(o_orderkey)::DOUBLE", "MAX(o_orderkey)::DOUBLE AS maximum")
    for q, label in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
        first = first.replace(f"quantile_cont(o_orderkey, {q})::DOUBLE", f"quantile_cont(o_orderkey, {q})::DOUBLE AS {label}")
    return " UNION ALL ".join([first, *parts[1:]])


@query("a19_profile", _profile_sql())
def _(t):
    types = F.when(F.col("type").startswith("timestamp"), "timestamp").otherwise(F.col("type"))
    return rounded(describe.profile(t.orders), 4, "mean").withColumn("type", types)


@query("a20_correlation", """SELECT 'l_quantity~l_extendedprice' AS pair, ROUND(corr(l_quantity, l_extendedprice), 9) AS r FROM {lineitem}
UNION ALL SELECT 'l_discount~l_tax', ROUND(corr(l_discount, l_tax), 9) FROM {lineitem}""")
def _(t):
    return rounded(describe.correlation(t.lineitem, [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]), 9, "r")


@query("a21_histogram", """WITH e AS (SELECT MIN(value) AS lo, MAX(value) AS hi FROM {events})
SELECT CAST(least(floor((value - lo) * 50 / (hi - lo)) + 1, 50) AS INT) AS bin, COUNT(*) AS n FROM {events}, e GROUP BY 1""")
def _(t):
    return describe.histogram(t.events, "value")


@query("a22_boxplot", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM {events} GROUP BY 1)
SELECT event_type, ROUND(ANY_VALUE(a), 6) AS q25, ROUND(ANY_VALUE(m), 6) AS median, ROUND(ANY_VALUE(b), 6) AS q75,
MIN(value) FILTER (WHERE value >= a - 1.5 * (b - a)) AS whisker_low, MAX(value) FILTER (WHERE value <= b + 1.5 * (b - a)) AS whisker_high,
COUNT(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers FROM {events} JOIN q USING (event_type) GROUP BY 1""")
def _(t):
    return rounded(describe.boxplot(t.events, "value", ["event_type"]), 6, "q25", "median", "q75")


@query("a23_read_survival", """WITH f AS (SELECT c_nationkey AS nation, COUNT(*) AS total, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS queries
FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1) SELECT nation, total, queries, ROUND(queries / (total * 0.5), 9) AS fraction FROM f""")
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"))
    funnel = df.agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("queries"))
    return rounded(describe.read_survival(funnel), 9, "fraction")


# ---------------------------------------------------------------- order
@query("w1_mid_ranks", """SELECT l_extendedprice AS value, COUNT(*) AS n, AVG(rn) AS mid_rank FROM
(SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS rn FROM {lineitem}) GROUP BY 1""")
def _(t):
    return ordering.mid_ranks(t.lineitem, "l_extendedprice")


@query("w2_autocorrelation", "WITH s AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS i, AVG(value) OVER () AS m FROM {events}) "
       + " UNION ALL ".join(f"SELECT {k} AS lag, ROUND((SELECT SUM((a.value - a.m) * (b.value - b.m)) FROM s a JOIN s b ON a.i = b.i + {k}) / (SELECT SUM((value - m) * (value - m)) FROM s), 9) AS acf" for k in range(13)))
def _(t):
    df = t.events.select("value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return rounded(ordering.autocorrelation(df, "value", "at", "event_id", 12), 9, "acf")


@query("w3_normal_scores", f"""SELECT idx, value, ROUND({normal_quantile_sql('p')}, 8) AS score FROM (SELECT idx, value, (idx + CAST(0.5 AS DOUBLE)) / n AS p FROM
(SELECT row_number() OVER (ORDER BY value) - 1 AS idx, value, COUNT(*) OVER () AS n FROM {{events}}))""")
def _(t):
    return rounded(ordering.normal_scores(t.events, "value", "event_id"), 8, "score")


@query("w4_quantile_groups", """WITH q AS (SELECT list_distinct([""" + ", ".join(f"quantile_cont(l_extendedprice, {i / 10})" for i in range(11)) + """]) AS cuts FROM {lineitem})
SELECT CAST(greatest(len(list_filter(cuts, lambda c: c < l_extendedprice)), 1) AS INT) AS bin, COUNT(*) AS n, MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high
FROM {lineitem}, q GROUP BY 1""")
def _(t):
    return ordering.quantile_groups(t.lineitem.select("l_extendedprice"), "l_extendedprice").groupBy("bin").agg(
        F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high")
    )


@query("w5_top_rows", "SELECT ts, event_id, value FROM {events} ORDER BY value DESC, event_id LIMIT 10")
def _(t):
    return ordering.top_rows(t.events.select("ts", "event_id", "value"), [F.desc("value"), "event_id"], 10)


# ---------------------------------------------------------------- diagnostics on given fitted values
@query("m7_overdispersion", f"""{SCORED} SELECT ROUND(SUM((y - fitted) ** 2 / (fitted * (1 - fitted))), 5) AS chisq,
ROUND(SUM((y - fitted) ** 2 / (fitted * (1 - fitted))) / (COUNT(*) - 4), 8) AS ratio, COUNT(*) - 4 AS rdf FROM s""")
def _(t):
    return diagnostics.overdispersion(scored(t), 3, 1).select(F.round("chisq", 5).alias("chisq"), F.round("ratio", 8).alias("ratio"), "rdf")


HL = """, q AS (SELECT list_distinct([""" + ", ".join(f"quantile_cont(fitted, {i / 10})" for i in range(11)) + """]) AS cuts FROM s),
b AS (SELECT greatest(len(list_filter(cuts, lambda c: c < fitted)), 1) AS bin, y, fitted FROM s, q)"""


@query("m8_goodness_of_fit", f"""{SCORED}{HL}, g AS (SELECT bin, SUM(y) AS o1, SUM(fitted) AS e1, SUM(1 - y) AS o0, SUM(1 - fitted) AS e0 FROM b GROUP BY 1)
SELECT ROUND(SUM((o1 - e1) ** 2 / e1 + (o0 - e0) ** 2 / e0), 5) AS chisq, COUNT(*) AS bins, 8 AS df FROM g""")
def _(t):
    return diagnostics.goodness_of_fit(scored(t)).select(F.round("chisq", 5).alias("chisq"), "bins", "df")


@query("m9_residuals", f"""{SCORED} SELECT l_orderkey, l_linenumber, ROUND((y - fitted) / sqrt(fitted * (1 - fitted)), 8) AS pearson,
ROUND(sign(y - fitted) * sqrt(2 * greatest((CASE WHEN y > 0 THEN y * ln(y / fitted) ELSE 0 END) + (CASE WHEN y < 1 THEN (1 - y) * ln((1 - y) / (1 - fitted)) ELSE 0 END), 0)), 8) AS deviance FROM s""")
def _(t):
    return scored(t).select(
        "l_orderkey", "l_linenumber", F.round(diagnostics.pearson_residual(), 8).alias("pearson"), F.round(diagnostics.deviance_residual(), 8).alias("deviance")
    )


@query("m10_binned_residuals", f"""{SCORED}{HL} SELECT CAST(bin AS INT) AS bin, COUNT(*) AS n, ROUND(AVG(fitted), 8) AS mean_fitted, ROUND(AVG(y - fitted), 8) AS mean_residual,
ROUND(2 * stddev_samp(y - fitted) / sqrt(COUNT(*)), 8) AS bound FROM b GROUP BY 1""")
def _(t):
    return rounded(diagnostics.binned_residuals(scored(t)), 8, "mean_fitted", "mean_residual", "bound")


@query("m11_residuals_by_predictor", f"""{SCORED}, r AS (SELECT kind, (y - fitted) / sqrt(fitted * (1 - fitted)) AS v FROM s),
q AS (SELECT kind, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.75) AS b FROM r GROUP BY 1)
SELECT kind, ROUND(ANY_VALUE(a), 6) AS q25, ROUND(ANY_VALUE(m), 6) AS median, ROUND(ANY_VALUE(b), 6) AS q75,
ROUND(MIN(v) FILTER (WHERE v >= a - 1.5 * (b - a)), 6) AS whisker_low, ROUND(MAX(v) FILTER (WHERE v <= b + 1.5 * (b - a)), 6) AS whisker_high,
COUNT(*) FILTER (WHERE v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outliers FROM r JOIN q USING (kind) GROUP BY 1""")
def _(t):
    return rounded(diagnostics.residuals_by_predictor(scored(t), "kind"), 6, "q25", "median", "q75", "whisker_low", "whisker_high")


# ---------------------------------------------------------------- tests
@query("m13_normality", f"""WITH s AS (SELECT value, (row_number() OVER (ORDER BY value) - CAST(0.375 AS DOUBLE)) / (COUNT(*) OVER () + CAST(0.25 AS DOUBLE)) AS p FROM {{events}})
SELECT COUNT(*) AS n, ROUND(corr(value, {normal_quantile_sql('p')}) ** 2, 8) AS w_prime FROM s""")
def _(t):
    return rounded(rank_tests.normality(t.events, "value", "event_id"), 8, "w_prime")


@query("m14_against_normal")
def _(t):
    return rank_tests.against_standard_normal(t.events, "value")


@query("m15_levene", f"""WITH f AS ({FRAME}), m AS (SELECT flag, median(y) AS med FROM f GROUP BY 1), d AS (SELECT flag, abs(y - med) AS d FROM f JOIN m USING (flag)),
g AS (SELECT flag, COUNT(*) AS n, AVG(d) AS a, SUM((d - (SELECT AVG(d) FROM d x WHERE x.flag = d.flag)) ** 2) AS ssw FROM d GROUP BY 1),
o AS (SELECT AVG(d) AS grand, COUNT(*) AS total FROM d)
SELECT ROUND((SUM(n * (a - grand) ** 2) / 2) / (SUM(ssw) / (ANY_VALUE(total) - 3)), 6) AS f, COUNT(*) - 1 AS df1, ANY_VALUE(total) - 3 AS df2 FROM g, o""")
def _(t):
    return rounded(rank_tests.levene(frame(t), "y", "flag"), 6, "f")


@query("m16_mann_whitney", """WITH s AS (SELECT l_tax AS v, l_returnflag AS g FROM {lineitem} WHERE l_returnflag IN ('A', 'R')),
k AS (SELECT v, COUNT(*) AS t, COUNT(*) FILTER (WHERE g = 'A') AS a FROM s GROUP BY 1),
r AS (SELECT *, SUM(t) OVER (ORDER BY v) - t + (t + 1) / 2 AS mid FROM k),
z AS (SELECT SUM(a)::DOUBLE AS nx, SUM(t)::DOUBLE AS n, SUM(a * mid)::DOUBLE AS rs, SUM(t::DOUBLE * t * t - t) AS ties FROM r),
w AS (SELECT nx, n - nx AS ny, n, rs - nx * (nx + 1) / 2 AS u, sqrt(nx * (n - nx) / 12 * ((n + 1) - ties / (n * (n - 1)))) AS sd FROM z)
SELECT u, ROUND((u - nx * ny / 2 - sign(u - nx * ny / 2) * 0.5) / sd, 8) AS z, ROUND(sd, 4) AS sd, nx::BIGINT AS n_first, ny::BIGINT AS n_second FROM w""")
def _(t):
    return rank_tests.mann_whitney(t.lineitem, "l_tax", "l_returnflag", "A", "R").select(
        "u", F.round("z", 8).alias("z"), F.round("sd", 4).alias("sd"), "n_first", "n_second"
    )


@query("m16_shift_estimate", """WITH s AS (SELECT floor(l_extendedprice / 100) AS v, l_returnflag AS g FROM {lineitem} WHERE l_returnflag IN ('A', 'R')),
k AS (SELECT v, COUNT(*) AS t, COUNT(*) FILTER (WHERE g = 'A') AS x, COUNT(*) FILTER (WHERE g = 'R') AS y FROM s GROUP BY 1),
z AS (SELECT SUM(x)::DOUBLE AS nx, SUM(y)::DOUBLE AS ny, SUM(t)::DOUBLE AS n, SUM(t::DOUBLE * t * t - t) AS ties FROM k),
w AS (SELECT nx * ny AS total, 1.959963984540054 * sqrt(nx * ny / 12 * ((n + 1) - ties / (n * (n - 1)))) AS reach FROM z),
d AS (SELECT a.v - b.v AS d, SUM(a.x * b.y) AS n FROM k a, k b GROUP BY 1), c AS (SELECT d, SUM(n) OVER (ORDER BY d) AS upto FROM d)
SELECT CAST((SELECT MIN(d) FROM c, w WHERE upto >= floor((total + 1) / 2)) + (SELECT MIN(d) FROM c, w WHERE upto >= ceil((total + 1) / 2)) AS DOUBLE) / 2 AS estimate,
(SELECT MIN(d) FROM c, w WHERE upto >= round(total / 2 - reach)) AS lower, (SELECT MIN(d) FROM c, w WHERE upto >= total - round(total / 2 - reach) + 1) AS upper""")
def _(t):
    df = t.lineitem.select(F.floor(F.col("l_extendedprice") / 100).alias("v"), "l_returnflag")
    found = rank_tests.shift_estimate(df, "v", "l_returnflag", "A", "R")
    row = [[round(found[k], 3) for k in ("estimate", "lower", "upper")]]
    return small_table(t.spark, "estimate double, lower double, upper double", row)


# ---------------------------------------------------------------- models
MEANS = f"WITH f AS ({FRAME}), m AS (SELECT flag, COUNT(*) AS n, AVG(y) AS p FROM f GROUP BY 1)"
COEF = """SELECT '(Intercept)' AS term, ROUND(ln(p) - ln(1 - p), 6) AS estimate, ROUND(sqrt(1 / (n * p * (1 - p))), 6) AS std_error FROM m WHERE flag = 'A'
UNION ALL SELECT 'flag=' || k.flag, ROUND(ln(k.p) - ln(1 - k.p) - (ln(a.p) - ln(1 - a.p)), 6), ROUND(sqrt(1 / (k.n * k.p * (1 - k.p)) + 1 / (a.n * a.p * (1 - a.p))), 6)
FROM m k JOIN m a ON a.flag = 'A' AND k.flag <> 'A'"""


def flag_fit(t: Tables):
    return glm.fit_glm(frame(t), "y", [FLAG])


@query("m1_binomial_model", f"{MEANS} SELECT *, 1 AS converged FROM ({COEF})")
def _(t):
    return rounded(glm.coefficients(t.spark, flag_fit(t)), 6, "estimate", "std_error").select("term", "estimate", "std_error", "converged")


@query("m1_nested_model", f"""WITH f AS ({FRAME}), m AS (SELECT kind, flag, AVG(y) AS p, COUNT(*) AS n FROM f GROUP BY 1, 2), e AS (SELECT kind, flag, ln(p) - ln(1 - p) AS eta, 1 / (n * p * (1 - p)) AS v FROM m)
SELECT *, 1 AS converged FROM (SELECT '(Intercept)' AS term, ROUND(eta, 6) AS estimate, ROUND(sqrt(v), 6) AS std_error FROM e WHERE kind = 'ECONOMY' AND flag = 'A'
UNION ALL SELECT 'kind=' || e.kind, ROUND(e.eta - r.eta, 6), ROUND(sqrt(e.v + r.v), 6) FROM e JOIN e r ON r.kind = 'ECONOMY' AND r.flag = 'A' WHERE e.flag = 'A' AND e.kind <> 'ECONOMY'
UNION ALL SELECT 'kind=' || e.kind || ':flag=' || e.flag, ROUND(e.eta - r.eta, 6), ROUND(sqrt(e.v + r.v), 6) FROM e JOIN e r ON r.kind = e.kind AND r.flag = 'A' WHERE e.flag <> 'A')""")
def _(t):
    fit = glm.fit_glm(frame(t), "y", [Nested(KIND, FLAG)])
    return rounded(glm.coefficients(t.spark, fit), 6, "estimate", "std_error").select("term", "estimate", "std_error", "converged")


# Newton's method on the covariate patterns, 3 x 3 systems solved by determinants.
_SUMS = """SUM(sy - n * mu) AS g0, SUM((sy - n * mu) * quantity) AS g1, SUM((sy - n * mu) * tax) AS g2, SUM(n * mu * (1 - mu)) AS a, SUM(n * mu * (1 - mu) * quantity) AS b,
SUM(n * mu * (1 - mu) * tax) AS c, SUM(n * mu * (1 - mu) * quantity * quantity) AS d, SUM(n * mu * (1 - mu) * quantity * tax) AS e, SUM(n * mu * (1 - mu) * tax * tax) AS f"""
_DET = "(a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d))"
NEWTON = f"""WITH RECURSIVE rows AS ({FRAME}), cells AS (SELECT quantity, tax, COUNT(*) AS n, SUM(y) AS sy FROM rows GROUP BY 1, 2),
steps(k, b0, b1, b2) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT k + 1, b0 + (g0 * (d * f - e * e) - b * (g1 * f - g2 * e) + c * (g1 * e - g2 * d)) / {_DET},
    b1 + (a * (g1 * f - g2 * e) - g0 * (b * f - c * e) + c * (b * g2 - c * g1)) / {_DET}, b2 + (a * (d * g2 - e * g1) - b * (b * g2 - c * g1) + g0 * (b * e - c * d)) / {_DET}
  FROM (SELECT k, b0, b1, b2, {_SUMS} FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * quantity + b2 * tax))) AS mu FROM steps, cells WHERE k < 12) GROUP BY k, b0, b1, b2)),
last AS (SELECT b0, b1, b2, {_SUMS} FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * quantity + b2 * tax))) AS mu FROM steps, cells WHERE k = 12) GROUP BY b0, b1, b2)"""


@query("m1_numeric_model", f"""{NEWTON} SELECT '(Intercept)' AS term, ROUND(b0, 6) AS estimate, ROUND(sqrt((d * f - e * e) / {_DET}), 6) AS std_error, 1 AS converged FROM last
UNION ALL SELECT 'quantity', ROUND(b1, 6), ROUND(sqrt((a * f - c * c) / {_DET}), 6), 1 FROM last UNION ALL SELECT 'tax', ROUND(b2, 6), ROUND(sqrt((a * d - b * b) / {_DET}), 6), 1 FROM last""")
def _(t):
    rows = glm.coefficients(t.spark, glm.fit_glm(frame(t), "y", [Numeric("quantity"), Numeric("tax")]))
    return rounded(rows, 6, "estimate", "std_error").select("term", "estimate", "std_error", "converged")


@query("m2_random_intercepts")
def _(t):
    fit = glmm.fit_glmm(frame(t), "y", [FLAG], ["region", "nation"])
    rows = [(n, e, s) for n, e, s, _, _ in fit.rows()] + [(f"variance {k}", v, None) for k, v in fit.random_variance.items()]
    return small_table(t.spark, "term string, estimate double, std_error double, converged int", [(*r, int(fit.converged)) for r in rows])


@query("m3_fit_by_subset", f"""WITH f AS ({FRAME}), m AS (SELECT kind, flag, AVG(y) AS p FROM f GROUP BY 1, 2), e AS (SELECT kind, flag, ln(p) - ln(1 - p) AS eta FROM m)
SELECT *, 1 AS converged FROM (SELECT kind AS subset, '(Intercept)' AS term, ROUND(eta, 6) AS estimate FROM e WHERE flag = 'A'
UNION ALL SELECT e.kind, 'flag=' || e.flag, ROUND(e.eta - r.eta, 6) FROM e JOIN e r ON r.kind = e.kind AND r.flag = 'A' WHERE e.flag <> 'A')""")
def _(t):
    fits = glm.fit_by_subset(frame(t), "y", [FLAG], KIND)
    return rounded(glm.coefficients(t.spark, fits), 6, "estimate").select("subset", "term", "estimate", "converged")


@query("m4_deletion_test", f"""{MEANS}, o AS (SELECT AVG(y) AS p, COUNT(*) AS n FROM f)
SELECT 'flag' AS term, ROUND(2 * ((SELECT SUM(n * (p * ln(p) + (1 - p) * ln(1 - p))) FROM m) - (SELECT n * (p * ln(p) + (1 - p) * ln(1 - p)) FROM o)), 5) AS lrt, 2 AS df""")
def _(t):
    return rounded(glm.deletion_tests(frame(t), "y", [FLAG]), 5, "lrt").select("term", "lrt", "df")


@query("m5_r_squared", f"""{MEANS}, v AS (SELECT var_samp(ln(p) - ln(1 - p)) AS fixed FROM f JOIN m USING (flag))
SELECT ROUND(fixed / (fixed + pi() * pi() / 3), 9) AS marginal, ROUND(fixed / (fixed + pi() * pi() / 3), 9) AS conditional FROM v""")
def _(t):
    marginal, conditional = glm.r_squared(flag_fit(t))
    return rounded(small_table(t.spark, "marginal double, conditional double", [[marginal, conditional]]), 9, "marginal", "conditional")


@query("m6_level_contrasts", f"""WITH f AS ({FRAME}), m AS (SELECT kind, ln(AVG(y)) - ln(1 - AVG(y)) AS eta, 1 / (COUNT(*) * AVG(y) * (1 - AVG(y))) AS v FROM f GROUP BY 1)
SELECT b.kind AS level, a.kind AS reference, ROUND(b.eta - a.eta, 7) AS estimate, ROUND((b.eta - a.eta) / sqrt(a.v + b.v), 7) AS z FROM m a JOIN m b ON a.kind < b.kind""")
def _(t):
    out = glm.level_contrasts(frame(t), "y", "kind")
    return out.select("level", "reference", F.round("estimate", 7).alias("estimate"), F.round("z", 7).alias("z"))


@query("m12_predictions", f"""{MEANS} SELECT flag, ROUND(p, 6) AS fit, ROUND(sqrt(p * (1 - p) / n), 6) AS se, ROUND(p - 1.96 * sqrt(p * (1 - p) / n), 6) AS lower,
ROUND(p + 1.96 * sqrt(p * (1 - p) / n), 6) AS upper FROM m""")
def _(t):
    grid = prediction_grid(t.spark, {"flag": ["A", "N", "R"]})
    return rounded(glm.predict(grid, flag_fit(t)), 6, "fit", "se", "lower", "upper")
