"""Order statistics without a single-task sort.

Ranks, quantiles and lags need a global order. Values are cut into buckets of about equal
size (cut points from a quantile sketch, a fixed number of doubles), each bucket is
ordered on its own, and bucket sizes added up give the offset of each. The cut points are
literals of the plan, so every branch and every retried task sees the same buckets; the
results are exact whatever the sketch's error is.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")


def _cuts(df: DataFrame, column: str, buckets: int) -> list[float]:
    """Quantile cut points; a value that spans several quantiles appears several times."""
    grid = [i / buckets for i in range(1, buckets)]
    return df.approxQuantile(column, grid, 0.25 / buckets) if buckets > 1 else []


def _buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bucketed(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    splits = [-INF, *sorted(set(cuts)), INF]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def value_counts(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Distinct values with their position: ``(by..., value, n, before, total)``.

    ``n`` rows carry the value, ``before`` rows of the group are smaller and the group has
    ``total`` rows. Equal values collapse before the shuffle, so a value shared by a third
    of all rows costs one row per input partition.
    """
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("value")).where(
        F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    )
    cuts = _cuts(rows, "value", _buckets(df))
    counted = _bucketed(rows.groupBy(*by, "value").agg(F.count("*").alias("n")), "value", cuts, "_bucket")
    sizes = counted.groupBy(*by, "_bucket").agg(F.sum("n").alias("_size"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        *by,
        "_bucket",
        (F.sum("_size").over(group.orderBy("_bucket")) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(group).alias("total"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("value")
    local = counted.withColumn("_before", F.sum("n").over(inside) - F.col("n"))
    return local.join(offsets, [*by, "_bucket"]).select(
        *by, "value", "n", (F.col("_offset") + F.col("_before")).alias("before"), "total"
    )


def quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, one row per group."""
    by = list(by)
    counted = value_counts(df, value, by)
    picks = []
    for name, p in probabilities.items():
        target = (F.col("total") - 1) * F.lit(float(p))
        low, weight = F.floor(target), target - F.floor(target)
        held = [
            F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value")))
            for k in (low, F.least(low + 1, F.col("total") - 1))
        ]
        share = F.max(weight)
        picks.append((held[0] + (held[1] - held[0]) * share).alias(name))
    return counted.groupBy(*by).agg(*picks)


def approximate_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] = (), accuracy: int = 10000
) -> DataFrame:
    """Sketched quantiles in one aggregation, for tables where exact ones are not needed."""
    return df.groupBy(*by).agg(
        *[F.percentile_approx(value, float(p), accuracy).alias(name) for name, p in probabilities.items()]
    )


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the rank tied rows share: ``(value, n, mid_rank)``."""
    counted = value_counts(df, value)
    return counted.select("value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("mid_rank"))


def global_index(df: DataFrame, order: str, tie: str, name: str = "idx") -> DataFrame:
    """Number rows 0, 1, 2, … by ``order`` and then ``tie`` (both numeric, together unique).

    A value of ``order`` so common that it spans several cut points gets a bucket of its
    own, which is cut again by ``tie``; so no bucket depends on how rows repeat.
    """
    buckets = _buckets(df)
    rows = df.withColumn("_order", F.col(order).cast("double")).withColumn("_tie", F.col(tie).cast("double"))
    cuts = _cuts(rows, "_order", buckets)
    hot = sorted({c for c in cuts if cuts.count(c) > 1})
    placed = _bucketed(rows, "_order", [*cuts, *[_next_up(h) for h in hot]], "_outer")
    if hot:
        placed = _bucketed(placed, "_tie", _cuts(rows, "_tie", buckets), "_inner").withColumn(
            "_inner", F.when(F.col("_order").isin(hot), F.col("_inner")).otherwise(0.0)
        )
    else:
        placed = placed.withColumn("_inner", F.lit(0.0))
    cell = ["_outer", "_inner"]
    sizes = placed.groupBy(*cell).agg(F.count("*").alias("_size"))
    running = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy(*cell))
    offsets = sizes.select(*cell, (running - F.col("_size")).alias("_offset"))
    local = F.row_number().over(Window.partitionBy(*cell).orderBy("_order", "_tie")) - 1
    return (
        placed.withColumn("_local", local)
        .join(offsets, cell)
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_order", "_tie", "_outer", "_inner", "_local", "_offset")
    )


def _next_up(value: float) -> float:
    import math

    return math.nextafter(value, INF)


def quantile_groups(df: DataFrame, value: str, groups: int = 10, name: str = "bin") -> DataFrame:
    """Bin number 1..g by quantile cut points; equal values always share a bin.

    Repeated cut points are merged, so there may be fewer than ``groups`` bins. Bins are
    closed on the right and the first one on both sides.
    """
    points = quantiles(df, value, {f"q{i}": i / groups for i in range(groups + 1)})
    edges = F.array_sort(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(groups + 1)])))
    cuts = points.select(edges.alias("edges")).scalar()
    position = F.size(F.filter("_edges", lambda edge: edge < F.col(value)))
    return df.withColumn("_edges", cuts).withColumn(name, F.greatest(position, F.lit(1))).drop("_edges")


def lagged(indexed: DataFrame, value: str, lags: int, block: int = 1_000_000) -> DataFrame:
    """Rows with the ``lags`` values before them as ``lag_1 …``, in index order.

    The order is cut into blocks of consecutive rows; the last rows of a block are also
    sent to the next one, so each block is complete on its own.
    """
    block = max(block, lags + 1)
    own = F.floor(F.col("idx") / block)
    homes = F.when(F.col("idx") % block >= block - lags, F.array(own, own + 1)).otherwise(F.array(own))
    rows = indexed.select("idx", F.col(value).alias("x"), F.explode(homes).alias("_block"))
    order = Window.partitionBy("_block").orderBy("idx")
    return rows.select(
        "idx", "x", "_block", *[F.lag("x", k).over(order).alias(f"lag_{k}") for k in range(1, lags + 1)]
    ).where(F.col("_block") == F.floor(F.col("idx") / block)).drop("_block")


def autocorrelation(df: DataFrame, value: str, order: str, tie: str, lags: int) -> DataFrame:
    """Autocorrelation of a series by lag ``0..lags``: ``(lag, acf)``."""
    rows = lagged(global_index(df.select(value, order, tie), order, tie), value, lags)
    mean = df.agg(F.avg(value)).scalar()
    centred = rows.withColumn("_m", mean).withColumn("_d", F.col("x") - F.col("_m"))
    sums = [F.sum(F.col("_d") * (F.col(f"lag_{k}") - F.col("_m"))).alias(str(k)) for k in range(1, lags + 1)]
    wide = centred.agg(F.sum(F.col("_d") * F.col("_d")).alias("0"), *sums)
    scaled = wide.select(*[(F.col(f"`{k}`") / F.col("`0`")).alias(str(k)) for k in range(lags + 1)])
    return scaled.unpivot([], [str(k) for k in range(lags + 1)], "lag", "acf").withColumn(
        "lag", F.col("lag").cast("int")
    )


def normal_scores(df: DataFrame, value: str, tie: str, offset: Column | float | None = None) -> DataFrame:
    """Order statistics against normal quantiles: ``(idx, value, score)``.

    Plotting positions are ``(i - a) / (n + 1 - 2a)`` with ``a`` = 3/8 up to ten rows and
    1/2 beyond, unless given.
    """
    from taxatally.functions.distributions import normal_quantile

    clean = df.where(F.col(value).isNotNull())
    n = clean.agg(F.count("*")).scalar()
    rows = global_index(clean.select(value, tie), value, tie).withColumn("_n", n)
    if offset is None:
        offset = F.when(F.col("_n") <= 10, 0.375).otherwise(0.5)
    elif not isinstance(offset, Column):
        offset = F.lit(float(offset))
    position = (F.col("idx") + 1 - offset) / (F.col("_n") + 1 - 2 * offset)
    return rows.select("idx", F.col(value).alias("value"), normal_quantile(position).alias("score"))


def top_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """First ``n`` rows of an order, found without sorting the whole table."""
    return df.orderBy(*order).limit(n)
