"""Checks of a fitted model, from rows that hold a response ``y`` and a fitted value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from taxatally.functions.distributions import chi_square_upper
from taxatally.operators.describe import boxplot
from taxatally.operators.ordering import quantile_groups


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail for the few rows of a test report."""
    return pd.Series([chi_square_upper(a, b) for a, b in zip(x, df, strict=True)])


def pearson_residual(y: str = "y", fitted: str = "fitted") -> Column:
    p = F.col(fitted)
    return (F.col(y) - p) / F.sqrt(p * (1 - p))


def deviance_residual(y: str = "y", fitted: str = "fitted") -> Column:
    """Signed root of twice the log-likelihood lost by the fitted value; ``0 log 0`` is 0."""
    v, p = F.col(y), F.col(fitted)
    one = F.when(v > 0, v * F.log(v / p)).otherwise(0.0)
    zero = F.when(v < 1, (1 - v) * F.log((1 - v) / (1 - p))).otherwise(0.0)
    return F.signum(v - p) * F.sqrt(2 * F.greatest(one + zero, F.lit(0.0)))


def overdispersion(scored: DataFrame, fixed_effects: int, random_intercepts: int = 0) -> DataFrame:
    """Pearson chi-square against its residual degrees of freedom: one row.

    Each random intercept is one variance parameter.
    """
    squares = F.sum(pearson_residual() ** 2).alias("chisq")
    rdf = (F.count("*") - F.lit(fixed_effects + random_intercepts)).alias("rdf")
    row = scored.agg(squares, rdf)
    return row.select(
        "chisq", (F.col("chisq") / F.col("rdf")).alias("ratio"), "rdf", chi_square_p("chisq", F.col("rdf").cast("double")).alias("p")
    )


def goodness_of_fit(scored: DataFrame, groups: int = 10) -> DataFrame:
    """Hosmer-Lemeshow test over quantile groups of the fitted value: one row."""
    bins = quantile_groups(scored, "fitted", groups).groupBy("bin").agg(
        F.sum("y").alias("o1"), F.sum("fitted").alias("e1"), F.sum(1 - F.col("y")).alias("o0"), F.sum(1 - F.col("fitted")).alias("e0")
    )
    part = (F.col("o1") - F.col("e1")) ** 2 / F.col("e1") + (F.col("o0") - F.col("e0")) ** 2 / F.col("e0")
    row = bins.agg(F.sum(part).alias("chisq"), F.count("*").alias("bins")).withColumn("df", F.lit(groups - 2))
    return row.withColumn("p", chi_square_p("chisq", F.col("df").cast("double")))


def binned_residuals(scored: DataFrame, groups: int = 10) -> DataFrame:
    """Mean fitted value and mean raw residual per bin, with bounds of two standard errors."""
    bins = quantile_groups(scored, "fitted", groups).withColumn("_res", F.col("y") - F.col("fitted"))
    return bins.groupBy("bin").agg(
        F.count("*").alias("n"),
        F.avg("fitted").alias("mean_fitted"),
        F.avg("_res").alias("mean_residual"),
        (2 * F.stddev_samp("_res") / F.sqrt(F.count("*"))).alias("bound"),
    )


def residuals_by_predictor(scored: DataFrame, predictor: str) -> DataFrame:
    """Box-plot figures of the Pearson residual for each level of a predictor."""
    return boxplot(scored.withColumn("residual", pearson_residual()), "residual", [predictor])
