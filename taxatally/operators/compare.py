"""Site, pond and survey-method comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.functions.numeric import detections
from taxatally.operators.counts import exclude
from taxatally.session import small_table


def mean_over_detections(shares: DataFrame, keys: list[str], value: str = "freq") -> DataFrame:
    """Mean per key over the rows above zero: a taxon seen on one day of five averages over one."""
    return detections(shares, value).groupBy(*keys).agg(F.avg(value).alias(value))


def pond_presence(shares: DataFrame, keys: list[str], value: str = "freq", name: str = "present") -> DataFrame:
    """1 for keys with anything above zero, otherwise 0."""
    return shares.groupBy(*keys).agg((F.max(value) > 0).cast("int").alias(name))


def with_site_rows(presence: DataFrame, keys: list[str], pond: str = "pond", value: str = "present") -> DataFrame:
    """Pond-level presence plus the same at site level as pond ``Site``, in one aggregation."""
    site_keys = [k for k in keys if k != pond]
    return (
        presence.groupingSets([keys, site_keys], *keys)
        .agg((F.max(value) > 0).cast("int").alias(value), F.grouping(pond).alias("_site"))
        .withColumn(pond, F.when(F.col("_site") == 1, "Site").otherwise(F.col(pond)))
        .select(*keys, value)
    )


def compare_methods(methods: dict[str, DataFrame], keys: list[str], value: str = "present") -> DataFrame:
    """One row per key and method with occupancy 0 or 1.

    A key known to any method gets a row for every method; where a method has no record
    the occupancy is 0. Each source is read once and all are aggregated together.
    """
    names = list(methods)
    tables = [df.select(*keys, F.lit(n).alias("method"), value) for n, df in methods.items()]
    stacked = tables[0]
    for table in tables[1:]:
        stacked = stacked.unionByName(table)
    wide = stacked.groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("method") == n, F.col(value))), F.lit(0)).alias(n) for n in names]
    )
    long = wide.unpivot(keys, names, "method", "occupancy")
    return long.withColumn("occupancy", (F.col("occupancy") > 0).cast("int"))


def drop_not_expected(rows: DataFrame, pairs: DataFrame | None = None, triples: DataFrame | None = None) -> DataFrame:
    """Remove species at sites (and at single ponds) where they are not expected."""
    spark = rows.sparkSession
    if pairs is None:
        pairs = small_table(spark, "site string, species string", fv.NOT_EXPECTED)
    if triples is None:
        triples = small_table(spark, "site string, species string, pond string", fv.NOT_EXPECTED_AT_POND)
    return exclude(exclude(rows, pairs, ["site", "species"]), triples, ["site", "species", "pond"])
