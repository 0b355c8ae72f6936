"""Single-step adjustment against the distribution of the range and against independent tests."""

import math
import statistics

import numpy as np
import pytest

from taxatally.operators import contrasts, glm, laplace
from taxatally.operators.glm import Factor, Nested
from taxatally.session import small_table


def range_upper(q, k):
    """Chance that the range of k standard normals exceeds q, by a plain integral."""
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    xs = np.linspace(-9, 9, 20001)
    return 1 - k * float(sum(math.exp(-x * x / 2) / math.sqrt(2 * math.pi) * (cdf(x) - cdf(x - q)) ** (k - 1) for x in xs) * (xs[1] - xs[0]))


@pytest.mark.parametrize("k", [2, 3, 6])
def test_equal_means(spark, k):
    pairs = [(i, j) for i in range(k) for j in range(i)]
    c = np.array([[(a == i) - (a == j) for a in range(k)] for i, j in pairs], float)
    z = np.linspace(0.5, 4, len(pairs))
    p, error = contrasts.adjusted(spark, z, c @ c.T)
    assert error < 1e-3
    for v, got in zip(z, p):
        assert got == pytest.approx(range_upper(v * math.sqrt(2), k), abs=5e-4)


def test_independent(spark):
    p, _ = contrasts.adjusted(spark, [2.0, -1.0, 3.0], np.diag([1.0, 4.0, 0.25]))
    one = [2 * statistics.NormalDist().cdf(-v) for v in (2.0, 1.0, 3.0)]
    assert p == pytest.approx([1 - (1 - q) ** 3 for q in one], abs=1e-3)


def test_chi_upper():
    for df in range(1, 12):
        assert contrasts.chi_upper(np.array([0.0, 40.0]), df) == pytest.approx([1, 0], abs=1e-12)
    assert contrasts.chi_upper(np.sqrt([3.841458820694124]), 1) == pytest.approx([0.05], abs=1e-9)
    assert contrasts.chi_upper(np.sqrt([18.307038053275146]), 10) == pytest.approx([0.05], abs=1e-9)
    assert contrasts.chi_upper(np.sqrt([14.067140449340169]), 7) == pytest.approx([0.05], abs=1e-9)


def data(spark):
    rng, rows = np.random.default_rng(8), []
    for i in range(900):
        kind, sub, grp = "abc"[i % 3], "xy"[i // 3 % 2], f"g{i % 10}"
        eta = {"a": 0, "b": 1.0, "c": 0.2}[kind] + 0.4 * (sub == "y") + (i % 10 - 4.5) / 10
        rows.append([kind, sub, grp, float(rng.random() < 1 / (1 + math.exp(-eta)))])
    return small_table(spark, "kind string, sub string, grp string, y double", rows)


def test_models(spark):
    df, kind, sub = data(spark), Factor("kind", ("a", "b", "c")), Factor("sub", ("x", "y"))
    fit = glm.fit_glm(df, "y", [kind])
    rows = {(r.level, r.reference): r for r in contrasts.compare_levels(spark, fit, "kind").collect()}
    plain = {(r.level, r.reference): r for r in glm.level_contrasts(df, "y", "kind").collect()}
    assert set(rows) == set(plain) == {("b", "a"), ("c", "a"), ("c", "b")}
    for key, r in rows.items():
        assert (r.estimate, r.std_error) == (pytest.approx(plain[key].estimate, abs=1e-6), pytest.approx(plain[key].std_error, rel=1e-5))
        assert 2 * statistics.NormalDist().cdf(-abs(r.z)) - 1e-3 <= r.p_single_step <= r.p_sidak + 1e-3
    nested = glm.fit_glm(df, "y", [Nested(kind, sub)])
    first = contrasts.compare_levels(spark, nested, "kind").collect()
    even = {(r.level, r.reference): r for r in contrasts.compare_levels(spark, nested, "kind", average=True).collect()}
    assert len(first) == 3 and even["b", "a"].estimate == pytest.approx(1, abs=0.5)
    inside = contrasts.compare_levels(spark, nested, "sub", within="b").first()
    assert (inside.level, inside.reference) == ("y", "x") and inside.estimate == pytest.approx(nested.beta[nested.names.index("kind=b:sub=y")])
    mixed = contrasts.compare_levels(spark, laplace.fit_laplace(df, "y", [kind], ["grp"]), "kind").collect()
    assert len(mixed) == 3 and min(r.p_single_step for r in mixed) < 0.01
    with pytest.raises(ValueError):
        contrasts.compare_levels(spark, fit, "sub")
