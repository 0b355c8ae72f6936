"""Binomial models with random intercepts, fitted by the Laplace approximation of their likelihood.

For given fixed effects and variances the intercepts of all random levels are moved to the mode of
their joint density by Newton steps: rows are added up per level, the equations of inner
levels are eliminated inside the aggregation, and the intercepts stay in a stored table. At
the mode one more aggregation gives the approximate likelihood (log-likelihood, squares of the
intercepts, logarithms of the determinants of all levels) and its exact gradient, the way the
mode moves included. The driver sees these sums only and searches over fixed effects and
logarithms of standard deviations, the latter between bounds.

One level, or an outer and an inner one nested in it. Levels of any number and size: a level is
a row of an aggregate, never a group in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from taxatally.operators.glm import INTERCEPT, Fit, Term, _symmetric, _triangle, design, fit_patterns, patterns
from taxatally.operators.glmm import _grouped, _numbers, _total, fit_glmm_patterns
from taxatally.session import stored

#: Bounds of a standard deviation; at the lower one it is reported as 0.
LOWEST, HIGHEST = 1e-3, 50.0
#: Largest Newton move of an intercept, and the moves after which a mode counts as found: the next ones
#: would be about their squares.
LONGEST_MOVE, SMALL_MOVE = 3.0, 1e-4


@dataclass
class Evaluation:
    """The approximate log-likelihood at one point, its gradient, and the modes there."""

    value: float
    gradient: np.ndarray
    information: np.ndarray
    modes: DataFrame


class Likelihood:
    """Of a table of covariate patterns that holds the keys of the random levels, ``n`` and ``sy``."""

    def __init__(self, cells: DataFrame, terms: Sequence[Term], random: Sequence[str], rounds: int = 30):
        self.terms, self.random, self.rounds = tuple(terms), list(random), rounds
        columns = design(terms)
        self.names = [INTERCEPT, *[n for n, _ in columns]]
        self.p, self.nested = len(self.names), len(self.random) == 2
        keys = [f"k{i}" for i in range(len(self.random))]
        x = [c.alias(f"x{i + 1}") for i, (_, c) in enumerate(columns)]
        held = cells.withColumnsRenamed(dict(zip(self.random, keys, strict=True)))
        # Terms that use a random level's column find it under both names.
        for name, key in zip(self.random, keys, strict=True):
            held = held.withColumn(name, held[key])
        self.keys, self.cells = keys, stored(held.selectExpr("*", "1D AS x0").select(*keys, "x0", *x, "n", "sy"), "cells")
        self.start = stored(self.cells.select(*keys).distinct().selectExpr(*keys, "0D AS u1", "0D AS u2", "0D AS move"), "modes")

    def _rows(self, modes: DataFrame, beta: np.ndarray) -> DataFrame:
        fixed = " + ".join(f"x{i} * {b}" for i, b in enumerate(_numbers(beta)))
        rows = self.cells.join(modes.drop("move"), self.keys).selectExpr("*", f"u1 + u2 + {fixed} AS eta").selectExpr("*", "1 / (1 + exp(-eta)) AS mu")
        return rows.selectExpr("*", "n * mu * (1 - mu) AS wt", "sy - n * mu AS res")

    def _eliminated(self, fine: DataFrame, variances: Sequence[float]) -> DataFrame:
        """Per finest level ``f`` and ``i``: what of the outer intercept remains, and the inner variance."""
        if not self.nested:
            return fine.selectExpr("*", "1D AS f", "0D AS i", "0D AS g2")
        v2 = _numbers(variances)[1]
        return fine.selectExpr("*", f"1 / (1 + w * {v2}) AS f", f"{v2} / (1 + w * {v2}) AS i", f"r - u2 / {v2} AS g2")

    def _moved(self, modes: DataFrame, beta: np.ndarray, variances: Sequence[float]) -> tuple[DataFrame, float]:
        """All intercepts after a Newton step, the fixed effects kept, and the largest move."""
        v1 = _numbers(variances)[0]
        fine = _grouped(self._rows(modes, beta), self.keys, ["max(u1) AS u1", "max(u2) AS u2", _total("wt", "w"), _total("res", "r")])
        fine = self._eliminated(fine, variances)
        outer = _grouped(fine, self.keys[:1], ["max(u1) AS top", _total("r - w * i * g2", "r1"), _total("w * f", "w1")])
        outer = outer.selectExpr(self.keys[0], f"(r1 - top / {v1}) / (w1 + 1 / {v1}) AS m1")
        both = fine.join(outer, self.keys[0]).selectExpr("*", "i * (g2 - w * m1) AS m2" if self.nested else "0D AS m2")
        both = both.selectExpr("*", f"least(1D, {LONGEST_MOVE}D / greatest(abs(m1), abs(m2), 1e-300D)) AS share")
        # A shortened step must be the same for all rows of an outer level, or its rows would disagree.
        least = _grouped(both, self.keys[:1], ["min(share) AS share"])
        both = both.drop("share").join(least, self.keys[0])
        moved = both.selectExpr(*self.keys, "u1 + share * m1 AS u1", "u2 + share * m2 AS u2", "greatest(abs(m1), abs(m2)) AS move")
        seen = Observation()  # the largest move comes with the writing, not from another job
        return stored(moved.observe(seen, F.max("move").alias("move")), "modes"), seen.get["move"]

    def modes(self, beta: np.ndarray, variances: Sequence[float], modes: DataFrame | None = None) -> DataFrame:
        """Intercepts ``u1``, ``u2`` of every level at the mode, searched from ``modes`` on."""
        modes = self.start if modes is None else modes
        for _ in range(self.rounds):
            modes, move = self._moved(modes, beta, variances)
            if move < SMALL_MOVE:
                break
        return modes

    def at(self, beta: np.ndarray, variances: Sequence[float], modes: DataFrame | None = None) -> Evaluation:
        """Value and gradient in the fixed effects and the logarithms of the standard deviations."""
        p, v = self.p, _numbers(variances)
        modes = self.modes(beta, variances, modes)
        rows = self._rows(modes, beta).selectExpr("*", "wt * (1 - 2 * mu) AS sk")
        fine = _grouped(rows, self.keys, [
            "max(u1) AS u1", "max(u2) AS u2", _total("wt", "w"), _total("res", "r"), _total("sk", "s"),
            _total("sy * eta - n * (greatest(eta, 0D) + log1p(exp(-abs(eta))))", "ll"),
            *[_total(f"wt * x{j}", f"a{j}") for j in range(p)], *[_total(f"sk * x{j}", f"c{j}") for j in range(p)],
            *[_total(f"res * x{j}", f"b{j}") for j in range(p)], *[_total(f"wt * x{j} * x{k}", f"h{j}_{k}") for j, k in _triangle(p)],
        ])
        fine = self._eliminated(fine, variances)
        # d(log determinant) = sum of k dw over finest levels, k = i + f * f / e, e of the outer level.
        outer = _grouped(fine, self.keys[:1], [
            "max(u1) AS u1", _total("ll", "ll"), _total("w * f", "q"), _total("u2 * u2", "uu2"), _total("-ln(f)", "log2"), "count(*) AS n2",
            *[_total(f"a{j} * f", f"ba{j}") for j in range(p)],
            *[_total(f"i * (c{j} - s * i * a{j})", f"ci{j}") for j in range(p)], *[_total(f"f * f * (c{j} - s * i * a{j})", f"cf{j}") for j in range(p)],
            _total("i * s * f", "si"), _total("f * f * s * f", "sf"), _total("w * i * u2", "pu"),
            _total("i * s * i * u2", "ui"), _total("f * f * s * i * u2", "uf"), _total("i * w", "iw"), _total("w * i * w * i", "wiwi"),
            *[_total(f"b{j}", f"b{j}") for j in range(p)], *[_total(f"h{j}_{k} - i * a{j} * a{k}", f"h{j}_{k}") for j, k in _triangle(p)],
        ]).selectExpr("*", f"q + 1 / {v[0]} AS e")
        shift = "(si + sf / e)"  # of the log determinant by the outer intercept
        totals = _grouped(outer, [], [
            _total("ll", "ll"), _total("u1 * u1", "uu1"), _total("uu2", "uu2"), _total("log2", "log2"), _total("n2", "n2"),
            _total(f"ln(e * {v[0]})", "log1"), "count(*) AS n1", _total("1 / e", "inv1"),
            _total(f"-{shift} * u1 / e", "by1"), _total(f"{shift} * pu / e - (ui + uf / e)", "by2"), _total("iw", "iw"), _total("wiwi / e", "wiwi"),
            *[_total(f"b{j} - 0.5D * (ci{j} + cf{j} / e - {shift} * ba{j} / e)", f"g{j}") for j in range(p)],
            *[_total(f"h{j}_{k} - ba{j} * ba{k} / e", f"h{j}_{k}") for j, k in _triangle(p)],
        ]).first()
        value = totals["ll"] - 0.5 * (totals["uu1"] / variances[0] + totals["log1"])
        # With respect to a precision 1 / v; one more factor -2 / v gives that to the log of the deviation.
        slopes = [-0.5 * (totals["uu1"] + totals["inv1"] - totals["n1"] * variances[0] + totals["by1"])]
        if self.nested:
            value -= 0.5 * (totals["uu2"] / variances[1] + totals["log2"])
            slopes.append(-0.5 * (totals["uu2"] - variances[1] * totals["iw"] + totals["wiwi"] + totals["by2"]))
        slopes = [-2 * s / x for s, x in zip(slopes, variances, strict=False)]
        gradient = np.array([*(totals[f"g{j}"] for j in range(p)), *slopes])
        return Evaluation(value, gradient, _symmetric([totals[f"h{j}_{k}"] for j, k in _triangle(p)], p), modes)


def _search(likelihood: Likelihood, beta: np.ndarray, deviations: np.ndarray, covariance: np.ndarray, fixed: bool, cap: int, tolerance: float):
    """Quasi-Newton ascent; a step that leaves the bounds ends on them. Gives the point, its evaluation, steps, success."""
    p, low, high = len(beta), math.log(LOWEST), math.log(HIGHEST)
    point = np.concatenate((beta, np.clip(np.log(deviations), low, high)))
    free = p if fixed else len(point)
    inverse = np.eye(len(point)) * 0.1
    inverse[:p, :p] = covariance

    def evaluate(at: np.ndarray, modes: DataFrame | None) -> Evaluation:
        return likelihood.at(at[:p], np.exp(2 * at[p:]).tolist(), modes)

    now = evaluate(point, None)
    for step in range(cap):
        slope = now.gradient.copy()
        slope[free:] = 0
        held = np.zeros(len(point), dtype=bool)
        held[p:] = ((point[p:] <= low) & (slope[p:] < 0)) | ((point[p:] >= high) & (slope[p:] > 0))
        slope[held] = 0
        masked = inverse.copy()
        masked[held], masked[:, held] = 0, 0
        move = masked @ slope
        move[free:] = 0
        promise = float(slope @ move)
        if promise < tolerance:
            return point, now, step, True
        move *= min(1.0, 2.0 / max(np.abs(move[p:]).max(initial=0), 1e-300))
        share = 1.0
        while True:
            target = point + share * move
            target[p:] = np.clip(target[p:], low, high)
            then = evaluate(target, now.modes)
            if then.value >= now.value + 1e-4 * float(slope @ (target - point)) or share < 1e-6:
                break
            share /= 4
        if then.value < now.value:
            return point, now, step, promise < 1e3 * tolerance
        moved, change = target - point, now.gradient - then.gradient
        change[free:] = 0
        if (curved := float(moved @ change)) > 1e-12:
            around = np.eye(len(point)) - np.outer(moved, change) / curved
            inverse = around @ inverse @ around.T + np.outer(moved, moved) / curved
        point, now = target, then
    return point, now, cap, False


def fit_laplace_patterns(cells: DataFrame, terms: Sequence[Term], random: Sequence[str], fixed_variances: Sequence[float] | None = None, cap: int = 40, tolerance: float = 1e-7) -> Fit:
    """Fit to a table of covariate patterns that also holds the random levels.

    The search begins at some steps of the joint-mode fit, or with given variances, which then stay, at a fit
    without random levels. A variance at its lower bound is reported as 0. The covariance
    is that of the fixed effects given the variances.
    """
    cells = stored(cells, "patterns")
    first = fit_patterns(cells, terms) if fixed_variances is not None else fit_glmm_patterns(cells, terms, list(random), cap=6)
    likelihood = Likelihood(cells, terms, random)
    begin = [max(v, 0.05) for v in (fixed_variances or list(first.random_variance.values()))]
    if fixed_variances is not None:
        begin = list(fixed_variances)
    point, found, steps, done = _search(likelihood, first.beta, np.sqrt(begin), first.covariance, fixed_variances is not None, cap, tolerance)
    p = likelihood.p
    deviations = np.exp(point[p:])
    names = ["/".join(random[: i + 1]) for i in range(len(random))]
    fixed = " + ".join(f"x{i} * {b}" for i, b in enumerate(_numbers(point[:p])))
    spread = _grouped(likelihood.cells.selectExpr("n", f"{fixed} AS eta"), [], [_total("n * eta", "s"), _total("n * eta * eta", "ss"), _total("n", "n")]).first()
    return Fit(
        tuple(terms), likelihood.names, point[:p], np.linalg.pinv(found.information), found.value, spread["n"],
        max((spread["ss"] - spread["s"] ** 2 / spread["n"]) / max(spread["n"] - 1, 1), 0.0),
        {n: (0.0 if d <= 2 * LOWEST else float(d * d)) for n, d in zip(names, deviations, strict=True)}, steps, done,
    )


def fit_laplace(df: DataFrame, y: str, terms: Sequence[Term], random: Sequence[str], fixed_variances: Sequence[float] | None = None) -> Fit:
    """Fixed effects plus random intercepts; ``random`` names one level, or an outer and an inner one."""
    return fit_laplace_patterns(patterns(df, y, terms, random), terms, random, fixed_variances)


def laplace_likelihood(df: DataFrame, y: str, terms: Sequence[Term], random: Sequence[str], beta: Sequence[float], variances: Sequence[float]) -> float:
    """The approximate log-likelihood at given fixed effects and variances."""
    likelihood = Likelihood(patterns(df, y, terms, random), terms, random)
    return likelihood.at(np.array(beta, float), list(variances)).value
