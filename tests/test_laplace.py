"""Models with random intercepts by the Laplace likelihood, against dense versions."""

import math
import random

import numpy as np
import pytest

from taxatally.functions.distributions import chi_square_upper
from taxatally.operators import glm, glmm, laplace
from taxatally.operators.glm import Factor, Numeric
from taxatally.session import small_table

KIND = Factor("kind", ("a", "b"))


def made(groups, inner, per, sd, sd2=0.0, seed=3, slope=0.8):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        u = rng.gauss(0, sd)
        for s in range(inner):
            v = rng.gauss(0, sd2)
            for i in range(per):
                kind = "ab"[i % 2]
                p = 1 / (1 + math.exp(-(-0.4 + slope * (kind == "b") + u + v)))
                rows.append([f"g{g}", f"s{s}", kind, float(rng.random() < p)])
    return rows


def frame(spark, rows):
    return small_table(spark, "grp string, sub string, kind string, y double", rows)


def softplus(x):
    return np.logaddexp(0, x)


def dense(rows, beta, variances, nested):
    """Laplace log-likelihood by one Newton search over all intercepts at once."""
    y = np.array([r[3] for r in rows])
    x = np.array([[1.0, float(r[2] == "b")] for r in rows])
    outer = sorted({r[0] for r in rows})
    inner = sorted({(r[0], r[1]) for r in rows})
    z = np.zeros((len(rows), len(outer) + (len(inner) if nested else 0)))
    for i, r in enumerate(rows):
        z[i, outer.index(r[0])] = 1
        if nested:
            z[i, len(outer) + inner.index((r[0], r[1]))] = 1
    prior = np.array([1 / variances[0]] * len(outer) + ([1 / variances[1]] * len(inner) if nested else []))
    u = np.zeros(z.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-(x @ beta + z @ u)))
        hessian = z.T @ ((mu * (1 - mu))[:, None] * z) + np.diag(prior)
        u = u + np.linalg.solve(hessian, z.T @ (y - mu) - prior * u)
    eta = x @ beta + z @ u
    mu = 1 / (1 + np.exp(-eta))
    hessian = z.T @ ((mu * (1 - mu))[:, None] * z) + np.diag(prior)
    return float((y * eta - softplus(eta)).sum() - 0.5 * (prior * u * u).sum() - 0.5 * (np.linalg.slogdet(hessian)[1] - np.log(prior).sum()))


@pytest.mark.parametrize("nested", [False, True])
def test_value_and_gradient(spark, nested):
    rows = made(5, 3, 8, 1.0, 0.7)
    levels = ["grp", "sub"] if nested else ["grp"]
    beta, variances = np.array([-0.2, 0.5]), [0.8, 0.3][: len(levels)]
    likelihood = laplace.Likelihood(glm.patterns(frame(spark, rows), "y", [KIND], levels), [KIND], levels)
    found = likelihood.at(beta, variances)
    assert found.value == pytest.approx(dense(rows, beta, variances, nested), abs=1e-8)
    point = np.concatenate((beta, 0.5 * np.log(variances)))
    for i in range(len(point)):
        step = np.zeros(len(point))
        step[i] = 1e-5
        up, down = (dense(rows, (point + s)[:2], np.exp(2 * (point + s)[2:]), nested) for s in (step, -step))
        assert found.gradient[i] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def quadrature(rows, beta, variance, nodes=60):
    """The likelihood itself: an integral for each group."""
    at, weight = np.polynomial.hermite_e.hermegauss(nodes)
    total = 0.0
    for g in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == g]
        eta = np.array([beta[0] + beta[1] * (r[2] == "b") for r in mine])[:, None] + math.sqrt(variance) * at[None]
        y = np.array([r[3] for r in mine])[:, None]
        logs = (y * eta - softplus(eta)).sum(axis=0) + np.log(weight) - 0.5 * math.log(2 * math.pi)
        total += np.logaddexp.reduce(logs)
    return total


def test_quadrature(spark):
    rows = made(8, 1, 40, 0.7)
    beta = np.array([-0.3, 0.6])
    got = laplace.laplace_likelihood(frame(spark, rows), "y", [KIND], ["grp"], beta, [0.5])
    assert got == pytest.approx(quadrature(rows, beta, 0.5), rel=1e-3)


def maximum(rows):
    """Maximum of the dense Laplace likelihood by a shrinking search."""
    best, size = np.array([-0.4, 0.8, 0.0]), 0.5
    value = dense(rows, best[:2], [math.exp(2 * best[2])], False)
    while size > 2e-4:
        for i in range(3):
            for sign in (1, -1):
                other = best.copy()
                other[i] += sign * size
                if (v := dense(rows, other[:2], [math.exp(2 * other[2])], False)) > value:
                    best, value = other, v
                    break
            else:
                continue
            break
        else:
            size /= 2
    return best, value


def test_fit_is_the_maximum_where_joint_modes_are_not(spark):
    rows = made(60, 1, 6, 1.5, seed=9)
    df = frame(spark, rows)
    fit = laplace.fit_laplace(df, "y", [KIND], ["grp"])
    best, value = maximum(rows)
    assert fit.converged and fit.log_likelihood == pytest.approx(value, abs=1e-4)
    assert fit.beta == pytest.approx(best[:2], abs=2e-3)
    assert fit.random_variance["grp"] == pytest.approx(math.exp(2 * best[2]), rel=5e-3)
    joint = glmm.fit_glmm(df, "y", [KIND], ["grp"]).random_variance["grp"]
    assert abs(fit.random_variance["grp"] - 1.5**2) < abs(joint - 1.5**2)
    assert dense(rows, fit.beta, [joint], False) < value - 1e-2


def test_no_variance(spark):
    rows = [[f"g{g}", "s", "ab"[i % 2], float(i % 4 < 2 if i % 2 else i % 8 < 2)] for g in range(6) for i in range(16)]
    df = frame(spark, rows)
    fit, plain = laplace.fit_laplace(df, "y", [KIND], ["grp"]), glm.fit_glm(df, "y", [KIND])
    assert fit.random_variance["grp"] == 0
    assert fit.beta == pytest.approx(plain.beta, abs=1e-3)
    assert fit.log_likelihood == pytest.approx(plain.log_likelihood, abs=1e-3)


def test_given_variances_and_what_follows_from_a_fit(spark):
    rows = made(10, 2, 30, 0.8, 0.5, slope=1.0)
    df = frame(spark, rows)
    fit = laplace.fit_laplace(df, "y", [KIND], ["grp", "sub"])
    assert 0.1 < fit.random_variance["grp"] < 3 and fit.converged
    given = laplace.fit_laplace(df, "y", [KIND], ["grp", "sub"], [0.64, 0.25])
    assert given.random_variance == pytest.approx({"grp": 0.64, "grp/sub": 0.25}) and given.log_likelihood <= fit.log_likelihood + 1e-6
    marginal, conditional = glm.r_squared(fit)
    random_part = sum(fit.random_variance.values())
    assert conditional - marginal == pytest.approx(random_part / (fit.fixed_variance + random_part + math.pi**2 / 3))
    tested = glm.deletion_tests(df, "y", [KIND], lambda c, t: laplace.fit_laplace_patterns(c, t, ["grp", "sub"]), ["grp", "sub"]).first()
    none = laplace.fit_laplace(df, "y", [], ["grp", "sub"])
    assert tested["lrt"] == pytest.approx(2 * (fit.log_likelihood - none.log_likelihood), abs=1e-4)
    assert tested["p"] == pytest.approx(chi_square_upper(tested["lrt"], 1)) and tested["p"] < 0.01


def test_numeric_term_and_a_large_level(spark):
    rng, rows = random.Random(5), []
    for g in range(40):
        u = rng.gauss(0, 1)
        for i in range(400 if g == 0 else 12):
            x = (i % 7) / 7
            rows.append([f"g{g}", x, float(rng.random() < 1 / (1 + math.exp(-(u + x))))])
    df = small_table(spark, "grp string, x double, y double", rows)
    fit = laplace.fit_laplace(df, "y", [Numeric("x")], ["grp"])
    assert fit.converged and fit.beta[1] == pytest.approx(1, abs=0.6) and fit.random_variance["grp"] == pytest.approx(1, abs=0.6)
