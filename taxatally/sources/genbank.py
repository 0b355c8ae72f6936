"""GenBank flat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _field(name: str) -> Column:
    return F.trim(F.regexp_extract("value", rf"(?m)^{name} +(.*)$", 1))


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """Reference records: accession, length, organism, taxon id, lineage, features, sequence.

    The terminator line separates records inside the scan, so each row is one record and
    all fields come from built-in text functions on it.
    """
    raw = spark.read.text(path, lineSep="\n//").select(F.regexp_replace("value", "\r", "").alias("value"))
    records = raw.where(F.col("value").rlike(r"(?m)^LOCUS "))
    organism_block = F.regexp_extract("value", r"(?s)\n  ORGANISM +(.*?)\n(?=\S)", 1)
    lineage_text = F.regexp_replace(F.regexp_extract(organism_block, r"(?s)^[^\n]*\n(.*)$", 1), r"\s+", " ")
    lineage = F.transform(F.split(F.regexp_replace(F.trim(lineage_text), r"\.$", ""), ";"), lambda n: F.trim(n))
    table = F.regexp_extract("value", r"(?s)\nFEATURES [^\n]*\n(.*?)\n(?=\S)", 1)
    blocks = F.regexp_extract_all(table, F.lit(r"(?s)((?:^|\n) {5}\S+ +[^\n]*(?:\n {21}[^\n]*)*)"), 1)
    return records.select(
        F.regexp_extract("value", r"(?m)^ACCESSION +(\S+)", 1).alias("accession"),
        _field("VERSION").alias("version"),
        F.regexp_extract("value", r"(?m)^LOCUS +\S+ +(\d+) bp", 1).try_cast("int").alias("length"),
        _field("DEFINITION").alias("definition"),
        F.regexp_extract(organism_block, r"^([^\n]*)", 1).alias("organism"),
        F.regexp_extract("value", r'/db_xref="taxon:(\d+)"', 1).try_cast("bigint").alias("taxon_id"),
        F.filter(lineage, lambda n: n != "").alias("lineage"),
        F.transform(blocks, _feature).alias("features"),
        F.regexp_replace(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), "[^A-Za-z]", "").alias("seq"),
    )


def _feature(block: Column) -> Column:
    """Struct ``(type, location, qualifiers)``; a value over several lines is one value."""
    flat = F.regexp_replace(block, r"\n {21}(?!/)", " ")
    marks = F.regexp_extract_all(flat, F.lit(r'(/[A-Za-z_]+(?:="[^"]*"|=[^\n]*)?)'), 1)
    pairs = F.transform(
        marks,
        lambda m: F.struct(
            F.regexp_extract(m, r"^/([A-Za-z_]+)", 1).alias("key"),
            F.regexp_replace(F.regexp_extract(m, r"(?s)=(.*)$", 1), '^"|"$', "").alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    # A repeated qualifier keeps all its values, joined by "; ".
    joined = F.transform(
        keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]), "; ")
    )
    return F.struct(
        F.regexp_extract(flat, r"^\s*(\S+)", 1).alias("type"),
        F.regexp_replace(F.regexp_extract(flat, r"(?s)^\s*\S+ +([^\n/]*)", 1), r"\s", "").alias("location"),
        F.map_from_arrays(keys, joined).alias("qualifiers"),
    )


def genbank_record(accession: Column, organism: Column, taxon_id: Column, lineage: Column, seq: Column) -> Column:
    """Flat-file text of a minimal record, without its terminator."""
    return F.concat(
        F.lit("LOCUS       "), accession, F.lit("  "), F.length(seq).cast("string"), F.lit(" bp    DNA     linear   VRT 01-JAN-2000\nDEFINITION  "),
        organism, F.lit(".\nACCESSION   "), accession, F.lit("\nVERSION     "), accession, F.lit(".1\nSOURCE      "), organism,
        F.lit("\n  ORGANISM  "), organism, F.lit("\n            "), F.array_join(lineage, ";\n            "),
        F.lit(".\nREFERENCE   1\nFEATURES             Location/Qualifiers\n     source          1.."), F.length(seq).cast("string"),
        F.lit('\n                     /organism="'), organism, F.lit('"\n                     /db_xref="taxon:'), taxon_id.cast("string"),
        F.lit('"\nORIGIN      \n        1 '), seq, F.lit("\n//"),
    )


def to_fasta(references: DataFrame) -> DataFrame:
    """References as rows ``(id, seq)`` for a FASTA file, named by accession and taxon id."""
    name = F.concat_ws("|", "accession", F.col("taxon_id").cast("string"), F.translate("organism", " ", "_"))
    return references.select(name.alias("id"), "seq")
