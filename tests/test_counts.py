"""Invented count tables with the edge cases of the study."""

from pyspark.sql import functions as F

from taxatally import fixed_values as fv
from taxatally.functions import ids
from taxatally.operators import counts as ct
from taxatally.operators import thresholds as th
from taxatally.plans.captive import mask_non_target, parse_captive, target_rows
from taxatally.plans.cleaning import compare_threshold_options, taxa_surviving_thresholds
from taxatally.session import small_table
from taxatally.sources import tables

COUNTS = "sample string, taxon string, reads bigint"


def as_dict(df, key, value):
    return {tuple(r[k] for k in key): r[value] for r in df.collect()}


def test_synonyms_keep_reads_and_merge(spark):
    rows = [["BAM01-01", a, i + 1] for i, (a, _) in enumerate(fv.SYNONYMS)] + [["BAM01-01", "Maylandia zebra", 100]]
    out = as_dict(ct.correct_names(small_table(spark, COUNTS, rows)), ["taxon"], "reads")
    assert sum(out.values()) == sum(r[2] for r in rows)
    zebra = [i + 1 for i, (_, b) in enumerate(fv.SYNONYMS) if b == "Maylandia zebra"]
    assert out[("Maylandia zebra",)] == 100 + sum(zebra)


def test_taxon_specific_threshold(spark):
    rows = [
        ["BAM01-01", "Lutra lutra", 10],
        ["BAM01-01", "Castor fiber", 90],
        ["TM01-01", "Lutra lutra", 30],
        ["TM01-01", "Maylandia zebra", 70],
        ["TM02-01", "Castor fiber", 0],
        ["L1-Positive-01", "Maylandia zebra", 90],
        ["L1-Positive-01", "Lutra lutra", 10],
        ["L1-Positive-02", "Maylandia zebra", 0],
        ["EB-Round01", "Lutra lutra", 5],
    ]
    out = as_dict(taxa_surviving_thresholds(small_table(spark, COUNTS, rows)), ["sample", "taxon"], "reads")
    # 10 of 100 equals the threshold and goes; the control species has threshold 0; a taxon
    # that is in no control has threshold 0.
    assert out == {
        ("BAM01-01", "Castor fiber"): 90,
        ("TM01-01", "Lutra lutra"): 30,
        ("TM01-01", "Maylandia zebra"): 70,
    }


def test_retention_of_empty_sample_is_zero(spark):
    freq = ct.proportions(small_table(spark, COUNTS, [["a", "x", 0], ["a", "y", 0], ["b", "x", 3], ["b", "y", 1]]))
    pos = ct.proportions(small_table(spark, COUNTS, [["p", "x", 1], ["p", "z", 9]]))
    kept = th.apply_taxon_thresholds(freq, th.taxon_thresholds(pos, "z"))
    out = as_dict(th.retention(kept, {"t": "kept"}), ["sample"], "retained")
    assert out == {("a",): 0.0, ("b",): 100.0}
    summary = {r["type"]: r for r in compare_threshold_options(freq, pos, "z").collect()}
    # Only the first option leaves empty samples out of its mean.
    assert summary["control species"]["mean_retained"] == 100.0
    assert summary["taxon-specific"]["mean_retained"] == 50.0


def test_frequencies_sum_to_one(spark):
    rows = [["a", "x", 3], ["a", "y", 4], ["b", "x", 0]]
    sums = as_dict(ct.proportions(small_table(spark, COUNTS, rows)).groupBy("sample").agg(F.sum("freq").alias("s")), ["sample"], "s")
    assert abs(sums[("a",)] - 1) < 1e-12 and sums[("b",)] == 0


def test_sample_ids(spark):
    names = [
        ("WWT-D02-Round02-LYNX-POOL", "LYNX", "DIR01", "Directed", "Ground-dwelling"),
        ("HWP-Round01-ZOO-BEAV", "BEAV", "ZOO", "Other", "Semi-aquatic"),
        ("WWT-D1-Round01-PM-P01", "PM", "STR01", "Stratified", "Arboreal"),
        ("WWT-D01-Round01-WV-1IND", "WV", "QUAR1", "Other", "Semi-aquatic"),
        ("HWP-Round01-SQ-BATH", "SQ", "BATH", "Other", "Arboreal"),
    ]
    df = parse_captive(small_table(spark, "sample string", [[n[0]] for n in names]))
    found = {r["sample"]: (r["enclosure"], r["sample_no"], r["sample_type"], r["lifestyle"]) for r in df.collect()}
    assert found == {n[0]: n[1:] for n in names}
    wild = small_table(spark, "sample string", [["BAM01-03"], ["TM02-07"], ["D03-THL02-01"]])
    got = {tuple(r[0]) for r in wild.select(ids.wild_parts("sample")).collect()}
    assert got == {
        ("Bamff Estate", "Pond 1", "03"),
        ("Thorne Moors", "Pond 2", "07"),
        ("Tophill Low Nature Reserve", "Pond 2", "01"),
    }


def test_masking_and_shared_sample(spark):
    rows = [
        ["HWP-Round01-SQ-BATH", "Meles meles", 5],
        ["HWP-Round01-SQ-BATH", "Sciurus vulgaris", 7],
        ["HWP-Round01-SQ-T01", "Meles meles", 3],
        ["HWP-Round01-OTT-T01", "Lutra lutra", 2],
    ]
    df = parse_captive(small_table(spark, COUNTS, rows))
    masked = as_dict(mask_non_target(df, "reads"), ["sample", "species"], "reads")
    assert masked[("HWP-Round01-SQ-T01", "Meles meles")] == 0
    assert masked[("HWP-Round01-SQ-BATH", "Meles meles")] == 5
    targets = {(r["sample"], r["species"], r["enclosure"]) for r in target_rows(df).collect()}
    assert targets == {
        ("HWP-Round01-SQ-BATH", "Meles meles", "BAD"),
        ("HWP-Round01-SQ-BATH", "Sciurus vulgaris", "SQ"),
        ("HWP-Round01-OTT-T01", "Lutra lutra", "OTT"),
    }


def test_files_with_other_line_ends(spark, tmp_path):
    (tmp_path / "cr.csv").write_bytes(b"Site,Pond,Castor fiber\rA,Pond 1,1\rA,Pond 2,0\r")
    rows = tables.read_wide_table(spark, str(tmp_path / "cr.csv"), ["Site", "Pond"]).collect()
    assert [r["Castor fiber"] for r in rows] == [1, 0]
    (tmp_path / "na.csv").write_bytes(b"Sample,Location,Individuals,Volume,No_filters,Notes\r\nx,L,NA,5,1,\r\n")
    row = tables.read_table(spark, str(tmp_path / "na.csv"), tables.CAPTIVE_SAMPLES).first()
    assert row["Individuals"] is None and row["Volume"] == 5


def test_count_table_import(spark, tmp_path):
    (tmp_path / "c.csv").write_text("# exported,,,\nOTU,S1-nc.blast,S2-nc.blast,taxomomy\nLutra_lutra,3,0,Chordata\nunassigned,0,2,unassigned\n")
    got = {tuple(r) for r in tables.read_count_table(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {
        ("S1", "Lutra_lutra", 3, "Chordata"),
        ("S2", "Lutra_lutra", 0, "Chordata"),
        ("S1", "unassigned", 0, "unassigned"),
        ("S2", "unassigned", 2, "unassigned"),
    }
