"""Long count tables ``(sample, taxon, reads)``: combine, correct, select, normalise.

A sample or taxon may hold a large share of all input rows. Every aggregation here is a
plain ``groupBy`` so rows collapse on the map side before they are shuffled, and no
window is opened over a sample or taxon.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.functions.numeric import ratio
from taxatally.session import small_table


def bind_rows(*tables: DataFrame) -> DataFrame:
    """Stack tables with the same columns, matched by name."""
    return reduce(DataFrame.unionByName, tables)


def bind_ragged(*tables: DataFrame, fill: int | float = 0) -> DataFrame:
    """Stack tables with differing columns; numbers missing on either side become ``fill``."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), tables
    ).fillna(fill)


def merge_assignments(
    counts: DataFrame, keys: Iterable[str] = ("sample", "taxon"), value: str = "reads"
) -> DataFrame:
    """One row per key with its reads added up."""
    return counts.groupBy(*keys).agg(F.sum(value).alias(value))


def sample_totals(counts: DataFrame, sample: str = "sample", value: str = "reads") -> DataFrame:
    """Total reads per sample as ``total``."""
    return counts.groupBy(sample).agg(F.sum(value).alias("total"))


def with_total_rows(counts: DataFrame, name: str = "Total") -> DataFrame:
    """Merged counts plus one ``Total`` row per sample, in a single aggregation."""
    return (
        counts.groupingSets([["sample", "taxon"], ["sample"]], "sample", "taxon")
        .agg(F.sum("reads").alias("reads"), F.grouping("taxon").alias("is_total"))
        .select(
            "sample",
            F.when(F.col("is_total") == 1, name).otherwise(F.col("taxon")).alias("taxon"),
            "reads",
        )
    )


def proportions(counts: DataFrame, totals: DataFrame | None = None, name: str = "freq") -> DataFrame:
    """Reads as a share of a per-sample total.

    ``totals`` is the denominator ``(sample, total)``: by default that of ``counts``
    itself, or e.g. the total over every raw assignment. Samples missing from it, or with
    a total of zero, get 0.
    """
    totals = sample_totals(counts) if totals is None else totals
    return counts.join(totals, "sample", "left").withColumn(name, ratio("reads", "total"))


def reads_from_share(shares: DataFrame, share: str = "freq", name: str = "reads") -> DataFrame:
    """Shares times their sample total, back as whole reads."""
    back = F.round(F.col(share) * F.col("total")).cast("bigint")
    return shares.withColumn(name, F.coalesce(back, F.lit(0).cast("bigint")))


def exclude(rows: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is not in the exclusion table."""
    return rows.join(listed, on, "left_anti")


def exclude_spurious(counts: DataFrame, names: list[str] = fv.SPURIOUS_TAXA) -> DataFrame:
    """Drop taxa that cannot occur at the sampled places."""
    listed = small_table(counts.sparkSession, "taxon string", [[n] for n in names])
    return exclude(counts, listed, "taxon")


def correct_names(counts: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Replace names by their accepted name, then merge rows that now agree.

    Rows are merged before the lookup as well, so the join sees one row per sample and
    name whatever the number of input rows of one name is.
    """
    if synonyms is None:
        synonyms = small_table(counts.sparkSession, "taxon string, accepted string", fv.SYNONYMS)
    merged = merge_assignments(counts)
    return merge_assignments(
        merged.join(synonyms, "taxon", "left").select(
            "sample", F.coalesce("accepted", "taxon").alias("taxon"), "reads"
        )
    )


def keep_lineage(counts: DataFrame, lineage: Column | str, pattern: str = fv.VERTEBRATE_PATTERN) -> DataFrame:
    """Rows whose lineage, as text or as an array of names, matches the pattern."""
    col = F.col(lineage) if isinstance(lineage, str) else lineage
    if isinstance(lineage, str) and counts.schema[lineage].dataType.typeName() == "array":
        return counts.where(F.exists(col, lambda name: name.rlike(pattern)))
    return counts.where(col.rlike(pattern))


def species_level(counts: DataFrame, pattern: str = fv.SPECIES_LEVEL_PATTERN) -> DataFrame:
    """Names resolved to species, plus the genera that are kept as they are."""
    return counts.where(F.col("taxon").rlike(pattern))


def matching(counts: DataFrame, column: str, pattern: str, keep: bool = True) -> DataFrame:
    """Rows whose column matches (or, with ``keep=False``, does not match) a pattern."""
    hit = F.col(column).rlike(pattern)
    return counts.where(hit if keep else ~hit)


def nonempty_taxa(counts: DataFrame, value: str = "reads") -> DataFrame:
    """Drop every taxon that is zero in all samples."""
    seen = counts.where(F.col(value) > 0).select("taxon").distinct()
    return counts.join(seen, "taxon", "left_semi")


def resolve_ids(records: DataFrame, lookup: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Records with their looked-up id, and the distinct keys that have none."""
    resolved = records.join(lookup, on, "inner")
    missing = records.select(on).distinct().join(lookup, on, "left_anti")
    return resolved, missing
