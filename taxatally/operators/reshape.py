"""Between long and wide tables, ordered levels and prediction grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatally.functions.ids import level_index


def melt(wide: DataFrame, ids: list[str], name: str = "taxon", value: str = "reads") -> DataFrame:
    """Wide to long; every column that is not an id becomes a row."""
    return wide.unpivot(ids, [F.col(f"`{c}`") for c in wide.columns if c not in ids], name, value)


def spread(
    long: DataFrame, rows: str | list[str], column: str, values: Sequence[str], measure: Column | str = "reads"
) -> DataFrame:
    """Long to wide with an explicit list of columns; absent cells are 0.

    The list is an argument so that no extra pass is needed to find it and the width of
    the result is a choice of the caller.
    """
    measure = F.col(measure) if isinstance(measure, str) else measure
    rows = [rows] if isinstance(rows, str) else rows
    return long.groupBy(*rows).pivot(column, list(values)).agg(F.sum(measure)).fillna(0)


def with_level(df: DataFrame, column: str, levels: list[str], name: str = "level", reverse: bool = False) -> DataFrame:
    """Add a factor's position; rows outside its levels are dropped, as unused levels are."""
    index = level_index(column, levels)
    if reverse:
        index = F.lit(len(levels) + 1).cast("int") - index
    return df.withColumn(name, index).where(F.col(name).isNotNull())


def used_levels(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in use."""
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def prediction_grid(
    spark: SparkSession,
    factors: dict[str, list[str]],
    ranges: dict[str, tuple[Column | float, Column | float]] | None = None,
    points: int = 500,
) -> DataFrame:
    """Every combination of factor levels and evenly spaced numbers.

    Each dimension is one ``explode`` of an array, so the grid grows inside one stage and
    no tables are crossed. Range ends may be scalar subqueries.
    """
    grid = spark.range(1).select()
    for name, levels in factors.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias(name))
    for name, (low, high) in (ranges or {}).items():
        low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
        steps = F.sequence(F.lit(0), F.lit(points - 1))
        grid = (
            grid.select("*", low.alias("_low"), high.alias("_high"), F.explode(steps).alias("_step"))
            .withColumn(name, F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_step") / (points - 1))
            .drop("_low", "_high", "_step")
        )
    return grid
