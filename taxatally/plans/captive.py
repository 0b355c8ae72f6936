"""Captive experiment: ids, target species per enclosure, metadata and behaviour joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.functions import ids
from taxatally.session import small_table


def parse_captive(rows: DataFrame) -> DataFrame:
    """Add ``id, enclosure, sample_no, location, sample_type, lifestyle`` read off the sample id."""
    parts = ids.captive_parts("sample")
    out = rows.select(
        "*",
        ids.captive_id("sample").alias("id"),
        parts["enclosure"].alias("enclosure"),
        parts["sample_no"].alias("sample_no"),
        parts["location"].alias("location"),
    )
    out = out.withColumn("sample_type", ids.sample_type("id"))
    out = out.withColumn("lifestyle", ids.enclosure_lifestyle("enclosure"))
    return out.withColumnRenamed("taxon", "species") if "taxon" in rows.columns else out


def housed_species(rows: DataFrame) -> DataFrame:
    """Lookup ``(enclosure, housed)``."""
    return small_table(rows.sparkSession, "enclosure string, housed string", [e[:2] for e in fv.ENCLOSURES])


def mask_non_target(rows: DataFrame, value: str = "freq") -> DataFrame:
    """Zero for every species but the one housed, except in samples left as they are."""
    keep = F.col("sample").isin(fv.UNMASKED_SAMPLES) | F.col("species").eqNullSafe(F.col("housed"))
    zero = F.lit(0).cast(rows.schema[value].dataType)
    return (
        rows.join(housed_species(rows), "enclosure", "left")
        .withColumn(value, F.when(keep, F.col(value)).otherwise(zero))
        .drop("housed")
    )


def target_rows(rows: DataFrame) -> DataFrame:
    """Only the housed species of each enclosure, plus the sample two enclosures share.

    The shared sample gives a second row, moved to the other enclosure. Both kinds of row
    come from one pass: a row is matched on the enclosure it is moved to.
    """
    sample, species, enclosure, lifestyle = fv.SHARED_SAMPLE
    shared = (F.col("sample") == sample) & (F.col("species") == species)
    moved = rows.withColumns(
        {
            "enclosure": F.when(shared, enclosure).otherwise(F.col("enclosure")),
            "lifestyle": F.when(shared, lifestyle).otherwise(F.col("lifestyle")),
        }
    )
    allowed = housed_species(rows).withColumnRenamed("housed", "species")
    return moved.join(allowed, ["enclosure", "species"])


def join_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Captive rows with their sample metadata; rows without any are dropped."""
    return rows.join(metadata, "sample")


def join_behaviour(targets: DataFrame, log: DataFrame) -> DataFrame:
    """One row per sample and behaviour; samples with several behaviours repeat."""
    return targets.join(log, ["id", "location", "enclosure", "sample_no"])
