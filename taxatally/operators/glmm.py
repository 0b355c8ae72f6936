"""Binomial models with random intercepts, one or two nested levels.

The reduced table of covariate patterns carries the random levels as keys. One iteration
is a Newton step for the fixed effects and all intercepts together: rows are added up per
random level, each level's own equations are eliminated inside the aggregation, and only
the sums of the size of the fixed effects reach the driver. Intercepts stay in a table
that is written to the shared folder once per iteration, so the lineage does not grow.
Variances follow from the intercepts and their conditional variances in the same step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatally.operators.glm import INTERCEPT, Fit, Term, _symmetric, _triangle, design, patterns
from taxatally.session import stored

ZERO = 1e-7


def _numbers(values: Sequence[float]) -> list[str]:
    """SQL text of numbers that change every iteration, read from one array constant.

    Spark compiles plain number literals into its generated code; an array constant is
    handed over as data, so all iterations share the code of the first.
    """
    held = "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"
    return [f"{held}[{i}]" for i in range(len(values))]


def _total(expr: str, name: str) -> str:
    return f"sum({expr}) AS {name}"


def _grouped(df: DataFrame, keys: list[str], totals: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.expr(e) for e in totals])


def _level_sums(cells: DataFrame, state: DataFrame | None, random: list[str], beta: np.ndarray) -> DataFrame:
    """Per finest random level: weights, scores and their products with the design."""
    p = len(beta)
    rows = cells.selectExpr("*", "0D AS u1", "0D AS u2") if state is None else cells.join(state, random)
    fixed = " + ".join(f"x{i} * {b}" for i, b in enumerate(_numbers(beta)))
    rows = rows.selectExpr("*", f"u1 + u2 + {fixed} AS eta").selectExpr("*", "1 / (1 + exp(-eta)) AS mu")
    rows = rows.selectExpr("*", "n * mu * (1 - mu) AS wt", "sy - n * mu AS res")
    totals = [
        "max(u1) AS u1",
        "max(u2) AS u2",
        _total("wt", "w"),
        _total("res", "r"),
        _total("sy * eta - n * (greatest(eta, 0D) + log1p(exp(-abs(eta))))", "ll"),
        *[_total(f"wt * x{i}", f"a{i}") for i in range(p)],
        *[_total(f"res * x{i}", f"b{i}") for i in range(p)],
        *[_total(f"wt * x{i} * x{j}", f"h{i}_{j}") for i, j in _triangle(p)],
    ]
    return _grouped(rows, random, totals)


def _outer_sums(fine: DataFrame, random: list[str], variances: list[float], p: int) -> DataFrame:
    """Per outer random level, with the inner level's equations already eliminated."""
    v = _numbers(variances)
    if len(random) == 2:
        fine = fine.selectExpr("*", f"w + 1 / {v[1]} AS d2", f"r - u2 / {v[1]} AS g2")
        inner = [
            _total("u2 * u2", "u2_squares"),
            _total("1 / d2", "inv_d2"),
            _total("w / d2 * w / d2", "cross_d2"),
            _total(f"ln(d2 * {v[1]})", "log_d2"),
            "count(*) AS g2_count",
        ]
    else:
        fine = fine.selectExpr("*", "0D AS g2")
        inner = [f"0D AS {c}" for c in ("u2_squares", "inv_d2", "cross_d2", "log_d2", "g2_count")]

    def less(full: str, mine: str, other: str) -> str:
        return f"{full} - {mine} * {other} / d2" if len(random) == 2 else full

    totals = [
        "max(u1) AS u1",
        _total(less("w", "w", "w"), "w1"),
        _total(less("r", "w", "g2"), "r1"),
        _total("ll", "ll"),
        *[_total(less(f"a{i}", "w", f"a{i}"), f"ra{i}") for i in range(p)],
        *[_total(less(f"b{i}", f"a{i}", "g2"), f"rb{i}") for i in range(p)],
        *[_total(less(f"h{i}_{j}", f"a{i}", f"a{j}"), f"rh{i}_{j}") for i, j in _triangle(p)],
        *inner,
    ]
    return _grouped(fine, [random[0]], totals).selectExpr("*", f"w1 + 1 / {v[0]} AS d1", f"r1 - u1 / {v[0]} AS g1")


def _global_sums(outer: DataFrame, variances: list[float], p: int):
    """The one row the driver sees."""
    v = _numbers(variances)
    totals = [
        *[_total(f"rh{i}_{j} - ra{i} * ra{j} / d1", f"s{i}_{j}") for i, j in _triangle(p)],
        *[_total(f"rb{i} - ra{i} * g1 / d1", f"t{i}") for i in range(p)],
        *[_total(c, c) for c in ("ll", "u2_squares", "log_d2", "g2_count")],
        _total("u1 * u1", "u1_squares"),
        _total("1 / d1", "var1"),
        _total("inv_d2 + cross_d2 / d1", "var2"),
        _total(f"ln(d1 * {v[0]})", "log_d1"),
        "count(*) AS g1_count",
    ]
    return _grouped(outer, [], totals).first()


def _next_state(fine: DataFrame, outer: DataFrame, random: list[str], variances: list[float], step: np.ndarray) -> DataFrame:
    """Intercepts after the step, per finest random level."""
    v, moves = _numbers(variances), _numbers(step)
    shift = " + ".join(f"ra{i} * {m}" for i, m in enumerate(moves))
    top = outer.selectExpr(random[0], f"(g1 - ({shift})) / d1 AS move1")
    rows = fine.join(top, random[0])
    if len(random) == 1:
        return rows.selectExpr(random[0], "u1 + move1 AS u1", "0D AS u2")
    inner = " + ".join(f"a{i} * {m}" for i, m in enumerate(moves))
    move2 = f"(r - u2 / {v[1]} - w * move1 - ({inner})) / (w + 1 / {v[1]})"
    return rows.selectExpr(*random, "u1 + move1 AS u1", f"u2 + {move2} AS u2")


def _variance(squares: float, levels: float, conditional: float, current: float) -> float:
    """Variance that agrees with the intercepts and their effective number."""
    return max(squares / max(levels - conditional / current, 1e-12), ZERO)


def _extrapolated(moves: list[float], updated: float, current: float) -> float:
    """Take the rest of a steadily shrinking series of moves on the log scale at once.

    At most a factor of 50 either way; the plain steps that follow correct it.
    """
    moves.append(math.log(updated / current))
    if len(moves) < 3 or moves[-1] * moves[-2] <= 0:
        return updated
    shrink = min(abs(moves[-1] / moves[-2]), 0.999)
    extra = max(-4.0, min(4.0, moves[-1] / (1 - shrink)))
    moves.clear()
    return max(current * math.exp(extra), ZERO)


def fit_glmm_patterns(
    cells: DataFrame,
    terms: Sequence[Term],
    random: list[str],
    cap: int = 40,
    tolerance: float = 1e-5,
    fixed_variances: list[float] | None = None,
) -> Fit:
    """Fit to a table of covariate patterns that also holds the random levels.

    Ends when the Newton step and the change of the variances are small. A variance that
    shrinks to nothing is reported as 0.
    """
    columns = design(terms)
    names = [INTERCEPT, *[n for n, _ in columns]]
    p, keys = len(names), list(random)
    x = [F.lit(1.0), *[c for _, c in columns]]
    cells = stored(cells.select(*keys, *[c.alias(f"x{i}") for i, c in enumerate(x)], "n", "sy"), "cells")
    total = cells.agg(F.sum("sy").alias("sy"), F.sum("n").alias("n")).first()
    mean = min(max(total["sy"] / total["n"], 1e-6), 1 - 1e-6)
    beta = np.zeros(p)
    beta[0] = math.log(mean / (1 - mean))
    variances = list(fixed_variances or [0.25] * len(keys))
    moves: list[list[float]] = [[] for _ in keys]
    fine = stored(_level_sums(cells, None, keys, beta), "levels")
    iterations, done, change = 0, False, 0.0
    while True:
        outer = _outer_sums(fine, keys, variances, p)
        sums = _global_sums(outer, variances, p)
        if fixed_variances is None and iterations >= 1 and not done:
            # The intercepts belong to the current variances: improve these, then step.
            parts = [("u1_squares", "g1_count", "var1"), ("u2_squares", "g2_count", "var2")][: len(keys)]
            better = [_variance(*(sums[c] for c in part), v) for part, v in zip(parts, variances, strict=True)]
            change = max(abs(b - v) / (v + 1e-3) for b, v in zip(better, variances, strict=True))
            variances = [_extrapolated(m, b, v) for m, b, v in zip(moves, better, variances, strict=True)]
            outer = _outer_sums(fine, keys, variances, p)
            sums = _global_sums(outer, variances, p)
        covariance = np.linalg.pinv(_symmetric([sums[f"s{i}_{j}"] for i, j in _triangle(p)], p))
        if done or iterations >= cap:
            break
        step = covariance @ np.array([sums[f"t{i}"] for i in range(p)])
        state = _next_state(fine, outer, keys, variances, step)
        beta = beta + step
        iterations += 1
        fine = stored(_level_sums(cells, state, keys, beta), "levels")
        done = iterations > 2 and float(np.max(np.abs(step))) < tolerance and change < 1e-3
    value = sums["ll"] - 0.5 * (sums["u1_squares"] / variances[0] + sums["log_d1"])
    if len(keys) == 2:
        value -= 0.5 * (sums["u2_squares"] / variances[1] + sums["log_d2"])
    fixed = " + ".join(f"x{i} * {b}" for i, b in enumerate(_numbers(beta)))
    spread = _grouped(cells.selectExpr("n", f"{fixed} AS eta"), [], [_total("n * eta", "s"), _total("n * eta * eta", "ss")]).first()
    return Fit(
        tuple(terms),
        names,
        beta,
        covariance,
        value,
        total["n"],
        max((spread["ss"] - spread["s"] ** 2 / total["n"]) / max(total["n"] - 1, 1), 0.0),
        {"/".join(keys[: i + 1]): (0.0 if v <= 2 * ZERO else v) for i, v in enumerate(variances)},
        iterations,
        done,
    )


def fit_glmm(df: DataFrame, y: str, terms: Sequence[Term], random: list[str]) -> Fit:
    """Fixed effects plus random intercepts; ``random`` names one level, or an outer and an inner one."""
    return fit_glmm_patterns(patterns(df, y, terms, random), terms, random)
