"""Contamination thresholds from control samples.

Thresholds are fractions of a sample's reads. A value survives only when it is strictly
above its threshold. Reads stay beside their frequency, so nothing is converted back
through floating point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.functions.ids import control_type
from taxatally.functions.numeric import presence, ratio
from taxatally.operators.counts import proportions


def max_frequency(freq: DataFrame) -> DataFrame:
    """Highest frequency of each taxon over the given samples."""
    return freq.groupBy("taxon").agg(F.max("freq").alias("threshold"))


def control_species_maximum(biological: DataFrame, species: str = fv.CONTROL_SPECIES) -> DataFrame:
    """One row: highest frequency of the control species in biological samples."""
    return biological.where(F.col("taxon") == species).agg(
        F.coalesce(F.max("freq"), F.lit(0.0)).alias("threshold")
    )


def control_contaminant_maximum(
    positive: DataFrame, species: str = fv.CONTROL_SPECIES, unassigned: str = fv.UNASSIGNED
) -> DataFrame:
    """One row: highest frequency of anything but the control species in positive controls."""
    return positive.where(~F.col("taxon").isin(species, unassigned)).agg(
        F.coalesce(F.max("freq"), F.lit(0.0)).alias("threshold")
    )


def taxon_thresholds(positive: DataFrame, species: str = fv.CONTROL_SPECIES) -> DataFrame:
    """Per taxon: highest frequency in positive controls; 0 for the control species."""
    return max_frequency(positive).withColumn(
        "threshold", F.when(F.col("taxon") == species, 0.0).otherwise(F.col("threshold"))
    )


def surviving(freq: Column, threshold: Column, reads: Column) -> Column:
    return F.when(freq > threshold, reads).otherwise(F.lit(0).cast("bigint"))


def apply_global_threshold(freq: DataFrame, threshold: DataFrame | float, name: str = "kept") -> DataFrame:
    """Reads left by one threshold for all taxa, as column ``name``.

    A one-row threshold table enters as a scalar subquery, so no join is made.
    """
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold.scalar()
    return freq.withColumn(name, surviving(F.col("freq"), limit, F.col("reads")))


def apply_taxon_thresholds(freq: DataFrame, thresholds: DataFrame, name: str = "kept") -> DataFrame:
    """Reads left by each taxon's own threshold; a taxon without one has threshold 0."""
    limits = thresholds.select("taxon", F.col("threshold").alias("_limit"))
    limit = F.coalesce("_limit", F.lit(0.0))
    return (
        freq.join(limits, "taxon", "left")
        .withColumn(name, surviving(F.col("freq"), limit, F.col("reads")))
        .drop("_limit")
    )


def retention(kept: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Taxa per sample before and after each threshold, in one aggregation.

    ``columns`` maps a threshold's name to its column of surviving reads. Result:
    ``(type, sample, before, after, retained)`` with ``retained`` in percent.
    """
    sums = [F.sum(presence(col).cast("bigint")).alias(name) for name, col in columns.items()]
    wide = kept.groupBy("sample").agg(F.sum(presence("reads").cast("bigint")).alias("before"), *sums)
    long = wide.unpivot(["sample", "before"], list(columns), "type", "after")
    return long.select("type", "sample", "before", "after", (ratio("after", "before") * 100).alias("retained"))


def retention_summary(retained: DataFrame, detections_only: list[str] = ()) -> DataFrame:
    """Lowest, highest and mean percentage retained per threshold.

    For the thresholds named in ``detections_only`` the mean leaves out samples in which
    nothing was retained.
    """
    skip = F.col("type").isin(list(detections_only)) & (F.col("retained") == 0)
    value = F.col("retained")
    return retained.groupBy("type").agg(
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        F.avg(F.when(~skip, value)).alias("mean_retained"),
    )


def contamination_profile(controls: DataFrame, sample: str = "sample") -> DataFrame:
    """Share of each taxon in each negative control, with the kind of control."""
    return proportions(controls).select(
        sample, control_type(sample).alias("control_type"), "taxon", "reads", "freq"
    )
