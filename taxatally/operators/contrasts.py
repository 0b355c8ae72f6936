"""All-pairs comparisons of the levels of a fitted model's factor, adjusted in a single step.

The largest of several correlated z values exceeds a bound with a probability that is one minus a
rectangle of a multivariate normal distribution. A normal vector is a direction times a length that
don't depend on each other; the length follows a chi distribution, so each direction gives the
probability of all lengths exactly, and only directions are sampled: by a shifted lattice
(quasi-Monte Carlo) that Spark's tasks deal out among them. Singular covariances, as those of all pairs are,
need no special care. Works for any fit with coefficients and their covariance, with random
levels or without.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatally.functions.distributions import two_sided_normal
from taxatally.operators.glm import INTERCEPT, Factor, Fit, Nested
from taxatally.session import small_table

#: Directions by shift of the lattice, shifts, directions that a task looks at together.
POINTS, SHIFTS, TOGETHER = 1 << 14, 8, 1 << 11
_erfc = np.frompyfunc(math.erfc, 1, 1)


def chi_upper(x: np.ndarray, df: int) -> np.ndarray:
    """Probability that the length of ``df`` standard normals exceeds ``x``."""
    half = np.asarray(x, float) ** 2 / 2
    term = np.exp(-half) if df % 2 == 0 else np.exp(-half) * np.sqrt(half) / math.gamma(1.5)
    out = np.zeros_like(half) if df % 2 == 0 else _erfc(np.sqrt(half)).astype(float)
    for k in range(df // 2):
        out = out + term
        term = term * half / (k + 1 if df % 2 == 0 else k + 1.5)
    return np.minimum(out, 1.0)


def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found if p * p <= at):
            found.append(at)
        at += 1
    return found


def directions(first: int, n: int, df: int, shift: int) -> np.ndarray:
    """Points ``first`` on of a lattice with the given shift, as unit vectors of ``df`` numbers."""
    pairs = -(-df // 2)
    steps = np.sqrt(np.array(_primes(2 * pairs), float))
    offset = np.random.default_rng(shift).random(2 * pairs)
    u = (np.arange(first + 1, first + n + 1)[:, None] * steps + offset) % 1
    length, angle = np.sqrt(-2 * np.log(1 - u[:, :pairs])), 2 * math.pi * u[:, pairs:]
    normal = np.concatenate((length * np.cos(angle), length * np.sin(angle)), axis=1)[:, :df]
    return normal / np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-300)


def adjusted(spark: SparkSession, z: Sequence[float], covariance: np.ndarray) -> tuple[np.ndarray, float]:
    """Chance that the largest of all absolute z values is at least each of ``z``, and its error.

    ``covariance`` is that of the estimates the z values belong to. The error is two standard
    errors over the shifts of the lattice, the largest of all.
    """
    z = np.abs(np.asarray(z, float))
    scale = np.sqrt(np.diag(covariance))
    values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    kept = values > 1e-10 * values.max()
    root, df = vectors[:, kept] * np.sqrt(values[kept]), int(kept.sum())
    blocks = -(-POINTS // TOGETHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                shift, at = divmod(block, blocks)
                n = min(TOGETHER, POINTS - at * TOGETHER)
                reach = np.abs(directions(at * TOGETHER, n, df, shift) @ root.T).max(axis=1)
                sums = np.array([chi_upper(v / reach, df).sum() for v in z])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), shift)), pa.array(np.arange(len(z))), pa.array(sums)], ["shift", "contrast", "total"])

    each = spark.range(0, SHIFTS * blocks, 1, min(SHIFTS * blocks, 64)).mapInArrow(run, "shift long, contrast long, total double")
    found = each.groupBy("shift", "contrast").agg(F.sum("total").alias("total")).toArrow()
    by_shift = np.zeros((SHIFTS, len(z)))
    by_shift[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy() / POINTS
    p = by_shift.mean(axis=0)
    return p, float(2 * (by_shift.std(axis=0, ddof=1) / math.sqrt(SHIFTS)).max())


def level_rows(fit: Fit, name: str, average: bool = False) -> tuple[tuple[str, ...], np.ndarray]:
    """The levels of a factor and, for each, the coefficients that make up its log odds.

    The outer factor of a nested term is compared at the first inner level, or with ``average``
    over all inner levels alike. Other terms are the same for all levels and left out.
    """
    for term in fit.terms:
        outer = term.outer if isinstance(term, Nested) else term
        if not isinstance(outer, Factor) or outer.name != name:
            continue
        rows = np.zeros((len(outer.levels), len(fit.names)))
        for i, level in enumerate(outer.levels):
            if i:
                rows[i, fit.names.index(f"{name}={level}")] = 1
            if average and isinstance(term, Nested):
                for inner in term.inner.levels[1:]:
                    rows[i, fit.names.index(f"{name}={level}:{term.inner.name}={inner}")] = 1 / len(term.inner.levels)
        return outer.levels, rows
    raise ValueError(f"{name} is not a factor of the model")


def inner_rows(fit: Fit, name: str, within: str) -> tuple[tuple[str, ...], np.ndarray]:
    """The levels of the inner factor of a nested term, inside one outer level."""
    for term in fit.terms:
        if isinstance(term, Nested) and term.inner.name == name:
            rows = np.zeros((len(term.inner.levels), len(fit.names)))
            for i, level in enumerate(term.inner.levels[1:], 1):
                rows[i, fit.names.index(f"{term.outer.name}={within}:{name}={level}")] = 1
            return term.inner.levels, rows
    raise ValueError(f"{name} is not the inner factor of a nested term")


def compare_levels(spark: SparkSession, fit: Fit, name: str, within: str | None = None, average: bool = False) -> DataFrame:
    """All pairs of levels: ``level, reference, estimate, std_error, z, p_single_step, p_sidak, p_error``.

    Pairs whose difference has no variance, as of a level that isn't in the data, are left out.
    """
    levels, rows = level_rows(fit, name, average) if within is None else inner_rows(fit, name, within)
    assert fit.names[0] == INTERCEPT
    pairs = [(i, j) for i in range(len(levels)) for j in range(i)]
    differences = np.array([rows[i] - rows[j] for i, j in pairs]).reshape(len(pairs), -1)
    covariance = differences @ fit.covariance @ differences.T if pairs else np.zeros((0, 0))
    known = np.flatnonzero(np.diag(covariance) > 1e-14 * max(np.diag(covariance).max(initial=0), 1e-300)) if pairs else np.empty(0, int)
    out = []
    if len(known):
        covariance, estimates = covariance[np.ix_(known, known)], differences[known] @ fit.beta
        errors = np.sqrt(np.diag(covariance))
        z = estimates / errors
        p, accuracy = adjusted(spark, z, covariance)
        for at, e, s, v, q in zip(known, estimates, errors, z, p, strict=True):
            i, j = pairs[at]
            sidak = -math.expm1(len(known) * math.log1p(-min(two_sided_normal(float(v)), 1 - 1e-16)))
            out.append((levels[i], levels[j], float(e), float(s), float(v), float(q), sidak, accuracy))
    return small_table(spark, "level string, reference string, estimate double, std_error double, z double, p_single_step double, p_sidak double, p_error double", out)
