"""Descriptive statistics, table profiles, histograms and box-plot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from taxatally.functions.numeric import ratio
from taxatally.operators.ordering import approximate_quantiles, quantiles
from taxatally.session import stored

FIVE = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}


def describe(df: DataFrame, value: str) -> DataFrame:
    """One row: n, min, max, range, quartiles, IQR, 5th and 95th percentile, variance, sd."""
    moments = df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.var_samp(value).alias("variance"),
        F.stddev_samp(value).alias("sd"),
    )
    points = quantiles(df, value, {**FIVE, "q5": 0.05, "q95": 0.95})
    field = {c: F.col("points")[c] for c in points.columns}
    return moments.withColumn("points", points.select(F.struct(*points.columns)).scalar()).select(
        "n",
        field["q0"].alias("minimum"),
        field["q100"].alias("maximum"),
        (field["q100"] - field["q0"]).alias("value_range"),
        field["q25"].alias("q25"),
        field["q50"].alias("median"),
        field["q75"].alias("q75"),
        (field["q75"] - field["q25"]).alias("iqr"),
        field["q5"].alias("q5"),
        field["q95"].alias("q95"),
        "mean",
        "variance",
        "sd",
    )


def extreme_rows(df: DataFrame, value: str, highest: bool = True) -> DataFrame:
    """Every row that holds the highest (or lowest) value, ties included."""
    pick = F.max if highest else F.min
    return df.where(F.col(value) == df.agg(pick(value)).scalar())


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, nulls, distinct values and, for numbers, min, quartiles, mean and max.

    Distinct values are counted as rows ``(column, value)`` that are made distinct first, so
    the table is written out once for all its columns. Quartiles are exact.
    """
    fields = df.schema.fields
    numbers = [f.name for f in fields if isinstance(f.dataType, NumericType)]
    stats = {
        "nulls": lambda c, num: F.count_if(F.col(c).isNull()),
        "minimum": lambda c, num: F.min(F.col(c).cast("double")) if num else F.lit(None).cast("double"),
        "mean": lambda c, num: F.avg(F.col(c).cast("double")) if num else F.lit(None).cast("double"),
        "maximum": lambda c, num: F.max(F.col(c).cast("double")) if num else F.lit(None).cast("double"),
    }
    row = df.agg(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("type"),
                *[make(f.name, f.name in numbers).alias(s) for s, make in stats.items()],
            ).alias(f"c{i}")
            for i, f in enumerate(fields)
        ]
    )
    table = row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(fields))])))
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).cast("string").alias("value")) for f in fields])))
    distinct = cells.where(F.col("value").isNotNull()).distinct().groupBy("column_name").agg(F.count("*").alias("distinct_values"))
    table = table.join(distinct, "column_name", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))
    for name in ("q25", "median", "q75"):
        table = table.withColumn(name, F.lit(None).cast("double"))
    for c in numbers:
        points = quantiles(df.select(F.col(c)), c, {"q25": 0.25, "median": 0.5, "q75": 0.75})
        found = points.select(F.struct("q25", "median", "q75")).scalar()
        own = F.col("column_name") == c
        table = table.withColumns({q: F.when(own, found[q]).otherwise(F.col(q)) for q in ("q25", "median", "q75")})
    return table


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equally wide bins from the minimum to the maximum: ``(bin, n)``.

    The last bin includes the maximum.
    """
    clean = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("value"))
    ends = clean.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.floor((F.col("value") - F.col("low")) * bins / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    return (
        clean.select("value", ends.select(F.struct("low", "high")).scalar().alias("ends"))
        .select("value", "ends.low", "ends.high")
        .select(F.least(F.coalesce(place, F.lit(0)) + 1, F.lit(bins)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )


def boxplot(df: DataFrame, value: str, by: list[str], exact: bool = True) -> DataFrame:
    """Box-plot figures per group: quartiles, whiskers within 1.5 IQR, number of outliers.

    Quartiles are stored, so Spark knows that they are few and doesn't move the rows of a group to one task.
    """
    find = quantiles if exact else approximate_quantiles
    quarts = stored(find(df, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by), "quartiles")
    fence = 1.5 * (F.col("q75") - F.col("q25"))
    rows = df.where(F.col(value).isNotNull()).join(quarts, by)
    inside = F.col(value).between(F.col("q25") - fence, F.col("q75") + fence)
    return rows.groupBy(*by).agg(
        F.max("q25").alias("q25"),
        F.max("median").alias("median"),
        F.max("q75").alias("q75"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def read_survival(funnel: DataFrame, total: str = "total", queries: str = "queries") -> DataFrame:
    """Share of read pairs that reached assignment; it may exceed 1 and is not clamped."""
    return funnel.withColumn(
        "fraction",
        F.when(F.col(queries).isNotNull(), ratio(F.col(queries), F.col(total) * 0.5)),
    )


def collapse_predictions(predictions: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Mean of fit and interval ends for each value of one predictor."""
    return predictions.groupBy(by).agg(*[F.avg(v).alias(v) for v in values])


def correlation(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation of each named pair, all in one pass: ``(pair, r)``."""
    wide = df.agg(*[F.corr(a, b).alias(f"{a}~{b}") for a, b in pairs])
    return wide.unpivot([], [f"`{a}~{b}`" for a, b in pairs], "pair", "r")
