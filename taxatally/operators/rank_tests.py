"""Tests on one numeric column: normality, equal spread, difference of two groups."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxatally.functions.distributions import f_upper, normal_upper, two_sided_normal
from taxatally.operators.ordering import _bucketed, _buckets, mid_ranks, normal_scores, quantiles, value_counts
from taxatally.session import stored


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: F of an analysis of variance on distances from the group median.

    Medians are stored, so Spark knows that they are few and doesn't move the rows of a group to one task.
    """
    medians = stored(quantiles(df, value, {"_median": 0.5}, [group]), "medians")
    rows = df.where(F.col(value).isNotNull()).join(medians, group)
    distance = F.abs(F.col(value) - F.col("_median"))
    groups = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.avg(distance).alias("m"), F.var_samp(distance).alias("v")
    )
    sums = groups.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("m")).alias("s"),
        F.sum(F.col("n") * F.col("m") ** 2).alias("ss"),
        F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("within"),
    )
    between = F.col("ss") - F.col("s") ** 2 / F.col("total")
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    return sums.select(((between / df1) / (F.col("within") / df2)).alias("f"), df1.alias("df1"), df2.alias("df2"))


def levene_p(row: DataFrame) -> float:
    r = row.first()
    return f_upper(r["f"], r["df1"], r["df2"])


def mann_whitney(df: DataFrame, value: str, group: str, first: str, second: str) -> DataFrame:
    """One row: U of the first group and its normal approximation.

    The variance is corrected for ties and the difference by one half for continuity.
    """
    two = df.where(F.col(group).isin(first, second) & F.col(value).isNotNull())
    ranks = mid_ranks(two, value)
    per = two.where(F.col(group) == first).groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("nx"))
    sums = ranks.join(per, "value", "left").agg(
        F.sum("n").alias("total"),
        F.sum("nx").alias("nx"),
        F.sum(F.col("nx") * F.col("mid_rank")).alias("rank_sum"),
        F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"),
    )
    nx, total = F.col("nx").cast("double"), F.col("total").cast("double")
    ny = total - nx
    row = sums.select(
        (F.col("rank_sum") - nx * (nx + 1) / 2).alias("u"),
        (nx * ny / 2).alias("mean"),
        F.sqrt(nx * ny / 12 * ((total + 1) - F.col("ties") / (total * (total - 1)))).alias("sd"),
        nx.cast("bigint").alias("n_first"),
        ny.cast("bigint").alias("n_second"),
    )
    shift = F.col("u") - F.col("mean")
    return row.select("u", ((shift - F.signum(shift) * 0.5) / F.col("sd")).alias("z"), "sd", "n_first", "n_second")


def _pairs_at_most(x: DataFrame, y: DataFrame, steps: list[float], cuts: list[float]) -> dict[float, int]:
    """For each step ``d``: how many pairs have ``x - y <= d``.

    ``x`` and ``y`` are distinct values with their counts, so no pair is ever formed: a
    pair counts when ``y >= x - d``, which a running count over both, ordered within
    buckets, gives for all steps at once.
    """
    marks = F.explode(F.array(*[F.lit(d) for d in steps])).alias("d")
    left = x.select(marks, "value", "n").select("d", (F.col("value") - F.col("d")).alias("at"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("probe"))
    right = y.select(marks, F.col("value").alias("at"), F.col("n").alias("below"), F.lit(0).cast("bigint").alias("probe"))
    both = left.unionByName(right).groupBy("d", "at").agg(F.sum("below").alias("below"), F.sum("probe").alias("probe"))
    both = _bucketed(both, "at", cuts, "b")
    sizes = both.groupBy("d", "b").agg(F.sum("below").alias("size"))
    by_step = Window.partitionBy("d")
    offsets = sizes.select(
        "d", "b", (F.sum("size").over(by_step.orderBy("b")) - F.col("size")).alias("offset"), F.sum("size").over(by_step).alias("ny")
    )
    inside = Window.partitionBy("d", "b").orderBy("at")
    before = both.withColumn("before", F.sum("below").over(inside) - F.col("below")).join(offsets, ["d", "b"])
    counts = before.groupBy("d").agg(F.sum(F.col("probe").cast("decimal(19,0)") * (F.col("ny") - F.col("offset") - F.col("before")).cast("decimal(19,0)")).cast("decimal(38,0)").alias("pairs"))
    return {r["d"]: int(r["pairs"]) for r in counts.collect()}


def shift_estimate(
    df: DataFrame, value: str, group: str, first: str, second: str, level: float = 0.95, width: int = 24, tolerance: float = 1e-7
) -> dict[str, float]:
    """Median of all pairwise differences between two groups, with a confidence interval.

    Three order statistics of the differences are bracketed together: every round counts
    the pairs below ``width`` candidate values in each bracket and keeps the part that
    holds the statistic, until it is narrower than ``tolerance`` of the range.
    """
    two = df.where(F.col(value).isNotNull())
    pick = [F.col("value"), F.col("n")]
    x = stored(value_counts(two.where(F.col(group) == first), value).select(*pick), "first")
    y = stored(value_counts(two.where(F.col(group) == second), value).select(*pick), "second")
    ends = [d.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n")).first() for d in (x, y)]
    nx, ny = ends[0]["n"], ends[1]["n"]
    sd = mann_whitney(two, value, group, first, second).first()["sd"]
    reach = NormalDist().inv_cdf(0.5 + level / 2) * sd
    pairs = nx * ny
    # Ranks as whole numbers, the lower and the upper of the two that are averaged.
    off = min(max(round(reach - (pairs % 2) / 2), 0), pairs // 2)
    ranks = {"estimate": ((pairs + 1) // 2, pairs // 2 + 1), "lower": (max(1, pairs // 2 - off),) * 2, "upper": (min(pairs, pairs - pairs // 2 + off + 1),) * 2}
    low, high = ends[0]["lo"] - ends[1]["hi"], ends[0]["hi"] - ends[1]["lo"]
    span = max(high - low, 1e-300)
    wanted = {f"{k}{i}": r for k, v in ranks.items() for i, r in enumerate(v)}
    brackets = {k: (low - span * 1e-9, high) for k in wanted}
    cuts = sorted({c for d in (x, y) for c in d.approxQuantile("value", [i / _buckets(df) for i in range(1, _buckets(df))], 0.01)})
    while max(b - a for a, b in brackets.values()) > tolerance * span:
        steps = sorted({a + (b - a) * i / width for a, b in brackets.values() for i in range(1, width)})
        counts = _pairs_at_most(x, y, steps, cuts)
        for k, (a, b) in brackets.items():
            under = [d for d in steps if a < d < b and counts[d] < wanted[k]]
            over = [d for d in steps if a < d < b and counts[d] >= wanted[k]]
            brackets[k] = (max(under, default=a), min(over, default=b))
    found = {k: b for k, (a, b) in brackets.items()}
    return {k: (found[f"{k}0"] + found[f"{k}1"]) / 2 for k in ranks}


def normality(df: DataFrame, value: str, tie: str) -> DataFrame:
    """One row ``(n, w_prime)``: squared correlation of order statistics with normal scores."""
    scores = normal_scores(df, value, tie, offset=0.375)
    return scores.agg(F.count("*").alias("n"), (F.corr("value", "score") ** 2).alias("w_prime"))


def normality_p(n: int, w_prime: float) -> float:
    """P value of W' by the published log-normal approximation (5 to 5000 rows)."""
    u = math.log(n)
    mean = -1.2725 + 1.0521 * (math.log(u) - u)
    sd = 1.0308 - 0.26758 * (math.log(u) + 2 / u)
    return normal_upper((math.log1p(-w_prime) - mean) / sd)


def against_standard_normal(df: DataFrame, value: str) -> DataFrame:
    """One row ``(p_value, statistic)``: one-sample Kolmogorov-Smirnov test against N(0, 1)."""
    row = KolmogorovSmirnovTest.test(df.select(F.col(value).cast("double").alias(value)), value, "norm", 0.0, 1.0)
    return row.select(F.col("pValue").alias("p_value"), "statistic")


__all__ = [
    "against_standard_normal", "levene", "levene_p", "mann_whitney", "normality", "normality_p", "shift_estimate", "two_sided_normal",
]
