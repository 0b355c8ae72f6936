"""Natural sites: pond occupancy from reads against other survey methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.functions import ids
from taxatally.operators import compare
from taxatally.operators.counts import nonempty_taxa

CELL = ["site", "pond", "species"]


def wild_frame(shares: DataFrame) -> DataFrame:
    """Detections with site, pond, replicate, lifestyle and vertebrate group."""
    rows = nonempty_taxa(shares, "freq").where("freq > 0")
    rows = rows.select("*", ids.wild_parts("sample").alias("_p")).select("*", "_p.*").drop("_p")
    return rows.withColumns(
        {"lifestyle": ids.species_lifestyle("taxon"), "vertebrate_group": ids.vertebrate_group("taxon")}
    )


def pond_means(shares: DataFrame) -> DataFrame:
    """Mean share per taxon, site, pond and replicate over the days it was seen."""
    keys = ["taxon", "vertebrate_group", "site", "pond", "replicate"]
    return compare.mean_over_detections(wild_frame(shares), keys)


def mammals(rows: DataFrame, taxon: str = "taxon") -> DataFrame:
    """Rows of the wild mammals that the survey methods can see."""
    return rows.where(F.col(taxon).isin(fv.MAMMALS))


def occupancy(shares: DataFrame) -> DataFrame:
    """From shares of reads to the mammals present at each pond, and at each site as pond ``Site``."""
    means = mammals(pond_means(shares)).withColumnRenamed("taxon", "species")
    table = compare.with_site_rows(compare.pond_presence(means, CELL), CELL)
    return table.withColumn("lifestyle", ids.species_lifestyle("species")).withColumnRenamed("present", "occupancy")


def method_comparison(edna: DataFrame, historical: DataFrame, field: DataFrame, camera: DataFrame) -> DataFrame:
    """Occupancy of each species by site, pond and method.

    Inputs hold ``(site, pond, species, present)``. Reads gain a ``Site`` row per site;
    the other sources bring their own where they have one.
    """
    methods = {
        "Cumulative survey data": historical,
        "Field signs": field,
        "Camera traps": camera,
        "eDNA": compare.with_site_rows(edna, CELL),
    }
    table = compare.compare_methods(methods, CELL)
    table = table.withColumn("lifestyle", ids.species_lifestyle("species"))
    return compare.drop_not_expected(table).select(*CELL, "lifestyle", "method", F.col("occupancy"))
