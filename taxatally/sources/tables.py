"""Delimited tables: metadata, manifests, count tables."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatally.functions.ids import strip_suffix
from taxatally.functions.numeric import to_count

# Column types of the study's sample table.
CAPTIVE_SAMPLES = "Sample STRING, Location STRING, Individuals INT, Volume INT, No_filters INT, Notes STRING"


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", null: str = "NA") -> DataFrame:
    """Delimited file with a header and a stated schema; any line ending.

    A schema means no extra pass to guess types and lets unused columns be skipped.
    """
    return spark.read.schema(schema).csv(path, sep=sep, header=True, nullValue=null)


def read_wide_table(spark: SparkSession, path: str, ids: list[str], sep: str = ",", null: str = "NA") -> DataFrame:
    """Wide table whose measured columns are named in the header, e.g. one per species.

    Names may hold spaces. Only the header line is looked at before the scan.
    """
    header = spark.read.csv(path, sep=sep, header=True).columns
    fields = [f"`{c}` {'STRING' if c in ids else 'INT'}" for c in header]
    return read_table(spark, path, ", ".join(fields), sep, null)


def write_table(df: DataFrame, path: str, sep: str = ",", null: str = "NA") -> None:
    """Delimited files with a header, one per partition."""
    df.write.csv(path, sep=sep, header=True, nullValue=null)


def read_count_table(spark: SparkSession, path: str, suffix: str = "-nc.blast") -> DataFrame:
    """Exported count table as long rows ``(sample, taxon, reads, lineage)``.

    Line 1 is a comment and line 2 the header: assignment, one column per sample with a
    tool suffix, taxonomy text last. Zero counts stay, so empty samples are not lost.
    """
    lines = spark.read.text(path)
    comment, header = (r.value for r in lines.limit(2).collect())
    names = next(csv.reader([header]))
    fields = ", ".join(f"`_c{i}` STRING" for i in range(len(names)))
    # The two leading lines are recognised as a whole, wherever a split begins.
    body = lines.where(~F.col("value").isin(comment, header) & (F.col("value") != ""))
    rows = body.select(F.from_csv("value", F.lit(fields)).alias("r")).select("r.*")
    last = len(names) - 1
    sample_columns = [F.col(f"_c{i}").alias(names[i]) for i in range(1, last)]
    wide = rows.select(F.col("_c0").alias("taxon"), F.col(f"_c{last}").alias("lineage"), *sample_columns)
    long = wide.unpivot(["taxon", "lineage"], [F.col(f"`{n}`") for n in names[1:last]], "sample", "text")
    return long.select(strip_suffix("sample", suffix).alias("sample"), "taxon", to_count("text").alias("reads"), "lineage")


def write_count_table(counts: DataFrame, path: str, samples: list[str], suffix: str = "", sep: str = ",", lineage: str | None = None) -> None:
    """Wide count table for export, one column per listed sample.

    ``lineage`` names a column of text that comes last; without it the table has none.
    """
    keys = ["taxon", *([lineage] if lineage else [])]
    wide = counts.groupBy(*keys).pivot("sample", samples).agg(F.sum("reads")).fillna(0, samples)
    renamed = wide.select(F.col("taxon").alias("Assignment"), *[F.col(f"`{s}`").alias(s + suffix) for s in samples], *keys[1:])
    write_table(renamed, path, sep)
