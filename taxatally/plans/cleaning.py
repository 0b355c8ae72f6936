"""From merged read counts to counts without contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame

from taxatally import fixed_values as fv
from taxatally.functions.ids import sample_role
from taxatally.operators import counts as ct
from taxatally.operators import thresholds as th
from taxatally.session import stored


def taxa_surviving_thresholds(
    lines: DataFrame,
    synonyms: DataFrame | None = None,
    control_species: str = fv.CONTROL_SPECIES,
    negative: str = fv.NEGATIVE_PATTERN,
    positive: str = fv.POSITIVE_PATTERN,
) -> DataFrame:
    """Taxa of each biological sample that exceed their taxon-specific threshold.

    The input rows are read and shuffled once; the merged counts, far smaller, are stored
    because the controls and the biological samples both start from them.
    """
    merged = stored(ct.correct_names(lines, synonyms), "counts")
    freq = ct.proportions(merged).withColumn("role", sample_role("sample", negative, positive))
    limits = th.taxon_thresholds(freq.where("role = 'positive'"), control_species)
    kept = th.apply_taxon_thresholds(freq.where("role = 'biological'"), limits)
    return kept.where("kept > 0").select("sample", "taxon", "reads", "freq")


def compare_threshold_options(biological: DataFrame, positive: DataFrame, control_species: str = fv.CONTROL_SPECIES) -> DataFrame:
    """Detections kept by each of the three kinds of threshold, from one pass over the samples."""
    kept = th.apply_global_threshold(biological, th.control_species_maximum(biological, control_species), "kept_1")
    kept = th.apply_global_threshold(kept, th.control_contaminant_maximum(positive, control_species), "kept_2")
    kept = th.apply_taxon_thresholds(kept, th.taxon_thresholds(positive, control_species), "kept_3")
    columns = {"control species": "kept_1", "other taxa": "kept_2", "taxon-specific": "kept_3"}
    return th.retention_summary(th.retention(kept, columns), ["control species"])
