"""Binomial models with logit link for a proportion response.

The likelihood only depends on how many rows share a covariate pattern and on the sum of
their responses. So the table is reduced to one row per pattern first, in one pass, and
the iterations run on that; with factors only, the result is as small as the design.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from taxatally.functions.distributions import chi_square_upper, two_sided_normal
from taxatally.functions.numeric import inverse_logit, logit
from taxatally.session import small_table, stored

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Factor:
    """Categorical term; the first level is the reference."""

    name: str
    levels: tuple[str, ...]

    @property
    def variables(self) -> list[str]:
        return [self.name]

    def columns(self) -> list[tuple[str, Column]]:
        return [(f"{self.name}={x}", self.is_level(x).cast("double")) for x in self.levels[1:]]

    def is_level(self, level: str) -> Column:
        """Whether a row has the level; a level that is not listed is an error, not the reference."""
        unlisted = F.raise_error(F.lit(f"{self.name} has a level that is not listed")).cast("boolean")
        return F.when(F.col(self.name).isin(*self.levels) | F.col(self.name).isNull(), F.col(self.name) == level).otherwise(unlisted)

    def reduced(self) -> Factor | None:
        return None


@dataclass(frozen=True)
class Numeric:
    """Numeric term."""

    name: str

    @property
    def variables(self) -> list[str]:
        return [self.name]

    def columns(self) -> list[tuple[str, Column]]:
        return [(self.name, F.col(self.name).cast("double"))]

    def reduced(self) -> None:
        return None


@dataclass(frozen=True)
class Nested:
    """``outer/inner``: the outer factor, and the inner one within each outer level."""

    outer: Factor
    inner: Factor

    @property
    def variables(self) -> list[str]:
        return [self.outer.name, self.inner.name]

    def columns(self) -> list[tuple[str, Column]]:
        within = [
            (f"{self.outer.name}={a}:{self.inner.name}={b}", (self.outer.is_level(a) & self.inner.is_level(b)).cast("double"))
            for a in self.outer.levels
            for b in self.inner.levels[1:]
        ]
        return self.outer.columns() + within

    def reduced(self) -> Factor:
        """What is left when the term is deleted: the outer factor it is marginal to."""
        return self.outer


Term = Factor | Numeric | Nested


def factor(df: DataFrame, name: str, limit: int = 1000) -> Factor:
    """Factor with the levels in use, in sorted order; a model term cannot have too many."""
    found = [r[0] for r in df.select(name).where(F.col(name).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{name} has more than {limit} levels and cannot be a fixed effect")
    return Factor(name, tuple(sorted(found)))


def variables(terms: Sequence[Term]) -> list[str]:
    return list(dict.fromkeys(v for t in terms for v in t.variables))


def design(terms: Sequence[Term]) -> list[tuple[str, Column]]:
    return [c for t in terms for c in t.columns()]


def patterns(df: DataFrame, y: str, terms: Sequence[Term], keys: Sequence[str] = ()) -> DataFrame:
    """One row per covariate pattern (and key): ``n`` rows with responses adding up to ``sy``.

    Only complete cases count: rows with a NULL response, variable or key are left out.
    """
    names = list(dict.fromkeys([*keys, *variables(terms)]))
    clean = df.dropna(subset=[y, *names]).select(*names, F.col(y).cast("double").alias("_y"))
    return clean.groupBy(*names).agg(F.count("*").alias("n"), F.sum("_y").alias("sy"))


@dataclass
class Fit:
    """Coefficients with their covariance; all of the size of the design."""

    terms: tuple[Term, ...]
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    n: int
    fixed_variance: float
    random_variance: dict[str, float] = field(default_factory=dict)
    iterations: int = 0
    converged: bool = True

    def rows(self) -> list[tuple[str, float, float, float, float]]:
        errors = np.sqrt(np.diag(self.covariance))
        return [
            (n, float(b), float(s), float(b / s), two_sided_normal(float(b / s)))
            for n, b, s in zip(self.names, self.beta, errors, strict=True)
        ]

    def linear(self) -> Column:
        cols = dict(design(self.terms))
        total = F.lit(float(self.beta[0]))
        for name, b in zip(self.names[1:], self.beta[1:], strict=True):
            total = total + cols[name] * float(b)
        return total


def _triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _symmetric(values: Sequence[float], p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for (i, j), v in zip(_triangle(p), values, strict=True):
        out[i, j] = out[j, i] = v
    return out


def log_likelihood_of(eta: Column) -> Column:
    """Σ over the rows of a pattern of ``y·eta - log(1 + exp(eta))``, without overflow."""
    softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    return F.col("sy") * eta - F.col("n") * softplus


def _summarise(cells: DataFrame, terms: Sequence[Term], names: list[str], beta: np.ndarray, iterations: int, cap: int) -> Fit:
    p = len(names)
    fit = Fit(tuple(terms), names, beta, np.zeros((p, p)), 0.0, 0, 0.0, {}, iterations, iterations < cap)
    x = [F.lit(1.0), *[c for _, c in design(terms)]]
    rows = cells.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], "n", "sy", fit.linear().alias("eta"))
    mu = inverse_logit("eta")
    weight = F.col("n") * mu * (1 - mu)
    eta, n = F.col("eta"), F.col("n")
    sums = rows.agg(
        *[F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i, j in _triangle(p)],
        F.sum(log_likelihood_of(eta)).alias("ll"),
        F.sum("n").alias("n"),
        F.sum(n * eta).alias("s"),
        F.sum(n * eta * eta).alias("ss"),
    ).first()
    fit.covariance = np.linalg.pinv(_symmetric([sums[f"h{i}_{j}"] for i, j in _triangle(p)], p))
    fit.log_likelihood, fit.n = sums["ll"], sums["n"]
    fit.fixed_variance = (sums["ss"] - sums["s"] ** 2 / fit.n) / max(fit.n - 1, 1)
    return fit


def fit_patterns(cells: DataFrame, terms: Sequence[Term], cap: int = 50) -> Fit:
    """Fit fixed effects to a table of covariate patterns."""
    columns = design(terms)
    names = [INTERCEPT, *[n for n, _ in columns]]
    if not columns:
        s = cells.agg(F.sum("sy").alias("sy"), F.sum("n").alias("n")).first()
        mean = s["sy"] / s["n"]
        return _summarise(cells, terms, names, np.array([math.log(mean / (1 - mean))]), 0, cap)
    inputs = [f"x{i}" for i in range(len(columns))]
    rows = cells.select(*[c.alias(x) for x, (_, c) in zip(inputs, columns, strict=True)], (F.col("sy") / F.col("n")).alias("label"), F.col("n").cast("double").alias("weight"))
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(rows)
    model = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="weight", maxIter=cap, tol=1e-12).fit(rows)
    beta = np.array([model.intercept, *model.coefficients.toArray()])
    return _summarise(cells, terms, names, beta, model.summary.numIterations, cap)


def fit_glm(df: DataFrame, y: str, terms: Sequence[Term]) -> Fit:
    """Fixed-effects binomial model with logit link."""
    return fit_patterns(stored(patterns(df, y, terms), "patterns"), terms)


def fit_by_subset(df: DataFrame, y: str, terms: Sequence[Term], by: Factor) -> dict[str, Fit]:
    """The same model on each level of ``by``; all subsets are reduced in one pass."""
    cells = stored(patterns(df, y, terms, [by.name]), "patterns")
    return {level: fit_patterns(cells.where(F.col(by.name) == level), terms) for level in by.levels}


def coefficients(spark, fits: dict[str, Fit] | Fit) -> DataFrame:
    """Coefficient table ``(subset, term, estimate, std_error, z, p, iterations, converged)``.

    ``converged`` is 0 for a fit that ran out of iterations.
    """
    fits = fits if isinstance(fits, dict) else {"all": fits}
    rows = [(k, *r, f.iterations, int(f.converged)) for k, f in fits.items() for r in f.rows()]
    return small_table(spark, "subset string, term string, estimate double, std_error double, z double, p double, iterations int, converged int", rows)


def deletions(terms: Sequence[Term]) -> list[tuple[str, list[Term]]]:
    """Each term's name with the terms that remain without it."""
    out = []
    for i, t in enumerate(terms):
        rest = [t.reduced()] if t.reduced() is not None else []
        name = ":".join(t.variables)
        out.append((name, [*terms[:i], *rest, *terms[i + 1 :]]))
    return out


def deletion_tests(df: DataFrame, y: str, terms: Sequence[Term], fit=fit_patterns, keys: Sequence[str] = ()) -> DataFrame:
    """Likelihood-ratio test of each term: ``(term, lrt, df, p)``.

    The full and all reduced models are fitted to one stored table of patterns.
    """
    cells = stored(patterns(df, y, terms, keys), "patterns")
    full = fit(cells, terms)
    rows = []
    for name, rest in deletions(terms):
        small = fit(cells, rest)
        lrt, change = 2 * (full.log_likelihood - small.log_likelihood), len(full.names) - len(small.names)
        rows.append((name, lrt, change, chi_square_upper(lrt, change)))
    return small_table(df.sparkSession, "term string, lrt double, df int, p double", rows)


def r_squared(fit: Fit) -> tuple[float, float]:
    """Share of variance explained by fixed effects, and by fixed and random effects."""
    fixed, random = fit.fixed_variance, sum(fit.random_variance.values())
    total = fixed + random + math.pi**2 / 3
    return fixed / total, (fixed + random) / total


def predict(grid: DataFrame, fit: Fit) -> DataFrame:
    """Grid with ``fit, se, lower, upper`` on the response scale, random effects at zero.

    The interval is fit ± 1.96 se and is not cut off at 0 and 1.
    """
    cols = dict(design(fit.terms))
    x = [F.lit(1.0), *[cols[n] for n in fit.names[1:]]]
    root = np.linalg.cholesky(fit.covariance + 1e-300 * np.eye(len(x)))
    grid = grid.select("*", *[c.alias(f"_x{i}") for i, c in enumerate(x)])
    spread = F.lit(0.0)
    for k in range(len(x)):
        form = F.lit(0.0)
        for i in range(k, len(x)):
            form = form + F.col(f"_x{i}") * float(root[i, k])
        spread = spread + form * form
    eta = F.lit(0.0)
    for i, b in enumerate(fit.beta):
        eta = eta + F.col(f"_x{i}") * float(b)
    p = F.col("fit")
    out = grid.withColumn("fit", inverse_logit(eta)).withColumn("se", p * (1 - p) * F.sqrt(spread))
    return out.withColumns({"lower": p - 1.96 * F.col("se"), "upper": p + 1.96 * F.col("se")}).drop(*[f"_x{i}" for i in range(len(x))])


def score(df: DataFrame, fit: Fit, y: str) -> DataFrame:
    """Rows with their response ``y`` and fitted value, for the diagnostics."""
    return df.withColumn("fitted", inverse_logit(fit.linear())).withColumn("y", F.col(y).cast("double"))


#: Blocks of levels by which the pairs of a contrast table are dealt out.
BLOCKS = 16


def level_contrasts(df: DataFrame, y: str, group: str) -> DataFrame:
    """All pairs of levels of one factor: difference in log odds, z and adjusted p.

    Equals the contrasts of the one-factor model. P values are Šidák-adjusted for the
    number of pairs. There is one row per level; pairs are made by a join of these rows, dealt by
    the blocks of both levels.
    """
    factor(df, group)  # raises when there are too many levels for a model term
    clean = df.where(F.col(y).isNotNull() & F.col(group).isNotNull())
    means = clean.groupBy(F.col(group).alias("level")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))
    stats = stored(means.select("level", logit("mean").alias("eta"), (1 / (F.col("n") * F.col("mean") * (1 - F.col("mean")))).alias("variance")), "levels")
    own, other = F.pmod(F.xxhash64("level"), F.lit(BLOCKS)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long")))
    side = lambda name, i, j: stats.select(F.struct("level", "eta", "variance").alias(name), i.alias("i"), j.alias("j"))
    pairs = side("x", own, other).join(side("y", other, own), ["i", "j"]).where(F.col("y.level") > F.col("x.level"))
    levels = stats.agg(F.count("*").cast("double")).scalar()
    diff, error = F.col("y.eta") - F.col("x.eta"), F.sqrt(F.col("x.variance") + F.col("y.variance"))
    out = pairs.select(
        F.col("y.level").alias("level"), F.col("x.level").alias("reference"), diff.alias("estimate"), error.alias("std_error"),
        (diff / error).alias("z"), (levels * (levels - 1) / 2).alias("pairs"),
    )
    return out.withColumn("p_sidak", 1 - F.pow(1 - _two_sided("z"), F.col("pairs"))).drop("pairs")


@F.pandas_udf(DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    """Two-sided normal tail for the few rows of a contrast table."""
    return pd.Series([two_sided_normal(v) for v in z])
