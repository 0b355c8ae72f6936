"""The W test against published values and simulated rows."""

import math

import numpy as np
import pytest

from taxatally.operators import rank_tests, shapiro
from taxatally.session import small_table

# Miles per gallon of 32 cars (Motor Trend, 1974); the test's result for them is in textbooks: W = 0.94756, p = 0.1229.
MPG = [21, 21, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26, 30.4, 15.8, 19.7, 15, 21.4]


def table(spark, values):
    return small_table(spark, "id bigint, v double", [(i, None if v is None else float(v)) for i, v in enumerate(values)])


def test_published(spark):
    n, w, p = shapiro.shapiro(table(spark, [*MPG, None]), "v", "id")
    assert (n, round(w, 5), round(p, 4)) == (32, 0.94756, 0.1229)


def test_small_and_odd(spark):
    # Heights of 15 women (World Almanac, 1975) are 58 to 72: W = 0.96359, p = 0.7545.
    n, w, p = shapiro.shapiro(table(spark, range(58, 73)), "v", "id")
    assert (round(w, 5), round(p, 4)) == (0.96359, 0.7545)
    n, w, p = shapiro.shapiro(table(spark, [1, 2, 3]), "v", "id")
    assert (n, w, p) == (3, 1.0, pytest.approx(1))
    assert all(math.isnan(x) for x in shapiro.shapiro(table(spark, [5, 5, 5, 5]), "v", "id")[1:])
    assert math.isnan(shapiro.shapiro(table(spark, [1, 2]), "v", "id")[1])
    for k in (4, 5, 6, 10):
        assert 0 < shapiro.shapiro(table(spark, [i * i for i in range(k)]), "v", "id")[2] < 1


def test_many_rows(spark):
    rng = np.random.default_rng(3)
    # The limit is reached slowly: where the published range ends p still differs by a tenth or so.
    rows = table(spark, rng.standard_normal(5000))
    n, w = shapiro.w_statistic(rows, "v", "id")
    assert shapiro.limit_p(rows, n, w) == pytest.approx(shapiro.w_p(n, w), abs=0.2)
    normal, skewed = rng.standard_normal(20000), rng.gamma(60, size=20000)
    assert shapiro.shapiro(table(spark, normal), "v", "id")[2] > 0.01
    assert shapiro.shapiro(table(spark, skewed), "v", "id")[2] < 1e-6


def test_weighted_chi_square():
    rng = np.random.default_rng(5)
    weights = 1 / np.arange(3, 40)
    drawn = ((rng.standard_normal((200_000, len(weights))) ** 2 - 1) * weights).sum(axis=1) + 0.1 * rng.standard_normal(200_000)
    for x in (-0.5, 0.0, 0.7, 2.0):
        assert shapiro.weighted_chi_square_upper(x, weights, 0.01) == pytest.approx((drawn > x).mean(), abs=5e-3)


def test_against_standard_normal(spark):
    rng = np.random.default_rng(1)
    values = rng.standard_normal(400) * 1.1
    row = rank_tests.against_standard_normal(table(spark, values), "v").first()
    cdf = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in np.sort(values)])
    i = np.arange(1, 401)
    d = max((i / 400 - cdf).max(), (cdf - (i - 1) / 400).max())
    assert row.statistic == pytest.approx(d, abs=1e-12)
    tail = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 400 * d * d) for k in range(1, 50))
    assert row.p_value == pytest.approx(tail, abs=0.02)
