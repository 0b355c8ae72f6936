"""Order statistics, tests and models against closed forms and brute force."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxatally.functions import distributions as dist
from taxatally.operators import describe, glm, glmm, ordering, rank_tests
from taxatally.operators.glm import Factor, Nested
from taxatally.session import small_table

random.seed(7)


def test_tails():
    assert dist.chi_square_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert dist.chi_square_upper(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert dist.f_upper(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.two_sided_normal(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_normal_quantile(spark):
    ps = [1e-12, 1e-4, 0.01, 0.08, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9]
    df = small_table(spark, "p double", [[p] for p in ps])
    for p, z in df.select("p", dist.normal_quantile(F.col("p")).alias("z")).collect():
        assert z == pytest.approx(statistics.NormalDist().inv_cdf(p), rel=1e-12, abs=1e-12)


def test_quantiles_with_a_hot_value(spark):
    values = [5.0] * 400 + [random.gauss(5, 3) for _ in range(600)]
    df = small_table(spark, "id bigint, v double", list(enumerate(values)))
    got = ordering.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.937}).first()
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.937)):
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    index = {r["id"]: r["idx"] for r in ordering.global_index(df, "v", "id").collect()}
    assert [i for i, _ in sorted(enumerate(values), key=lambda x: (x[1], x[0]))] == sorted(index, key=index.get)


def test_lags_over_block_borders(spark):
    values = [random.random() for _ in range(57)]
    df = small_table(spark, "idx bigint, v double", list(enumerate(values)))
    rows = {r["idx"]: r for r in ordering.lagged(df, "v", 3, block=5).collect()}
    assert len(rows) == 57
    assert all(rows[i][f"lag_{k}"] == (values[i - k] if i >= k else None) for i in rows for k in (1, 2, 3))


def test_shift_estimate(spark):
    x, y = [random.gauss(1, 1) for _ in range(41)], [random.gauss(0, 1) for _ in range(37)]
    df = small_table(spark, "g string, v double", [["a", v] for v in x] + [["b", v] for v in y])
    found = rank_tests.shift_estimate(df, "v", "g", "a", "b")
    assert found["estimate"] == pytest.approx(statistics.median(a - b for a in x for b in y), abs=1e-5)
    assert found["lower"] < found["estimate"] < found["upper"]


def test_normality(spark):
    n = 200
    even = [statistics.NormalDist().inv_cdf((i + 0.625) / (n + 0.25)) for i in range(n)]
    row = rank_tests.normality(small_table(spark, "id bigint, v double", list(enumerate(even))), "v", "id").first()
    assert row["w_prime"] == pytest.approx(1, abs=1e-9)
    skewed = [math.exp(2 * v) for v in even]
    row = rank_tests.normality(small_table(spark, "id bigint, v double", list(enumerate(skewed))), "v", "id").first()
    assert rank_tests.normality_p(n, row["w_prime"]) < 1e-6


def frame(spark, groups=12, per=60, sigma=1.0):
    rows = []
    for g in range(groups):
        u = statistics.NormalDist().inv_cdf((g + 0.5) / groups) * sigma
        for i in range(per):
            kind = "ab"[i % 2]
            p = 1 / (1 + math.exp(-(0.3 + 0.8 * (kind == "b") + u)))
            rows.append([f"g{g}", kind, f"g{g}-{i % 3}", float(random.random() < p)])
    return small_table(spark, "grp string, kind string, sub string, y double", rows)


def test_random_intercepts(spark):
    df, kind = frame(spark), Factor("kind", ("a", "b"))
    cells = glm.patterns(df, "y", [kind], ["grp"]).cache()
    fit = glmm.fit_glmm_patterns(cells, [kind], ["grp"])
    assert fit.converged and 0.3 < math.sqrt(fit.random_variance["grp"]) < 1.6
    assert fit.beta[1] == pytest.approx(0.8, abs=0.6)
    marginal, conditional = glm.r_squared(fit)
    assert 0 < marginal < conditional < 1
    # A variance held at almost nothing gives the model without random effects.
    plain = glm.fit_glm(df, "y", [kind])
    held = glmm.fit_glmm_patterns(cells, [kind], ["grp"], fixed_variances=[1e-9])
    assert np.allclose(held.beta, plain.beta, atol=1e-4)
    assert held.log_likelihood == pytest.approx(plain.log_likelihood, abs=1e-3)
    assert fit.log_likelihood > held.log_likelihood


def test_deletion_respects_nesting(spark):
    df = frame(spark)
    terms = [Nested(Factor("kind", ("a", "b")), Factor("half", ("x", "y")))]
    df = df.withColumn("half", F.when(F.col("sub").endswith("0"), "x").otherwise("y"))
    row = glm.deletion_tests(df, "y", terms).first()
    assert row["term"] == "kind:half" and row["df"] == 2 and 0 <= row["p"] <= 1


def test_too_many_levels_for_a_term(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("g"), F.lit(0.5).alias("y"))
    with pytest.raises(ValueError, match="more than 1000 levels"):
        glm.level_contrasts(df, "y", "g")


def test_contrasts_are_joined_from_one_row_per_level(spark):
    n = 60
    rows = [(f"g{i:02d}", float(k <= i)) for i in range(n) for k in range(n + 2)] + [(None, 1.0), ("g00", None)]
    out = glm.level_contrasts(spark.createDataFrame(rows, "g string, y double"), "y", "g")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {(r["level"], r["reference"]): r for r in out.collect()}
    assert len(got) == n * (n - 1) // 2 and all(a > b for a, b in got)
    eta, var = lambda i: math.log((i + 1) / (n + 1 - i)), lambda i: (n + 2) / ((i + 1) * (n + 1 - i))
    for (a, b), r in got.items():
        i, j = int(a[1:]), int(b[1:])
        assert r["estimate"] == pytest.approx(eta(i) - eta(j)) and r["std_error"] == pytest.approx(math.sqrt(var(i) + var(j)))
        p = math.erfc(abs(r["z"]) / math.sqrt(2))
        assert r["p_sidak"] == pytest.approx(1 - (1 - p) ** (n * (n - 1) / 2), abs=1e-6)


def test_models_take_complete_cases_and_refuse_unlisted_levels(spark):
    import pytest

    from taxatally.operators import glm, glmm

    rows = [("a", i % 5 == 0) for i in range(50)] + [("b", i % 2 == 0) for i in range(50)]
    df = spark.createDataFrame([(g, float(y), f"r{i % 4}") for i, (g, y) in enumerate(rows)], "g string, y double, pond string")
    more = df.union(spark.createDataFrame([(None, 1.0, "r0"), ("a", None, "r1"), ("a", 1.0, None)], df.schema))
    terms = [glm.Factor("g", ("a", "b"))]
    plain, full = glm.fit_glm(df, "y", terms), glm.fit_glm(more.where("pond is not null"), "y", terms)
    assert plain.n == full.n == 100 and abs(plain.beta - full.beta).max() < 1e-9
    assert [r["converged"] for r in glm.coefficients(spark, plain).collect()] == [1, 1]
    assert glmm.fit_glmm(more, "y", terms, ["pond"]).n == 100
    odd = df.union(spark.createDataFrame([("c", 1.0, "r0")], df.schema))
    for fit in (lambda: glm.fit_glm(odd, "y", terms), lambda: glmm.fit_glmm(odd, "y", terms, ["pond"])):
        with pytest.raises(Exception, match="not listed"):
            fit()


def test_pair_counts_beyond_a_bigint(spark):
    from taxatally.operators.rank_tests import _pairs_at_most

    side = lambda v: spark.createDataFrame([(v, 8_000_000_000)], "value double, n bigint")
    assert _pairs_at_most(side(1.0), side(0.0), [0.5, 1.5], [0.5]) == {0.5: 0, 1.5: 64 * 10**18}


@pytest.mark.parametrize("exact", [True, False])
def test_rows_of_few_groups_stay_where_they_are(spark, exact):
    """Each row meets the median or quartiles of its group without a shuffle by group."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.hash("id") % 1000).cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (rank_tests.levene(rows, "v", "g"), describe.boxplot(rows, "v", ["g"], exact))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for plan in plans)
