"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("low").alias("a"), "b").filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("low"))
    moved = links.join(least, "b").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.filter("a < b").union(least.select(F.col("low").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that has a link (``a``, ``b``, both ``long``).

    ``root`` is the smallest node of the component; it is in the result too. Rounds go on until
    the links no longer change; each is stored, so lost executors cost one round at most.
    Order, repetition and self-links don't matter; no links give an empty result.
    """
    now = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = stored(now, "links")
    before = print_of(now)
    while before[0]:
        now = stored(_small_star(_large_star(now)), "links")
        after = print_of(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
