"""Query manifests: which files hold the reads of a sample, and how to clip them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatally import fixed_values as fv


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Paths below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(folder).select("path")


def paired_manifest(paths: DataFrame, clip: int = fv.PRIMER_BASES) -> DataFrame:
    """``(sample, format, file1, file2, clip_fwd, clip_rev)`` from files named ``…_R1.…``, ``…_R2.…``.

    The sample is the file name up to the mate mark. A sample with one file keeps NULL for
    the other; the combined ``GLOBAL`` entry is left out.
    """
    name = F.substring_index("path", "/", -1)
    parts = paths.select(
        "path",
        F.regexp_extract(name, r"^(.*?)[_.]R[12]\b", 1).alias("sample"),
        F.regexp_extract(name, r"[_.]R([12])\b", 1).alias("mate"),
    ).where("mate <> '' AND NOT contains(sample, 'GLOBAL')")
    files = [F.max(F.when(F.col("mate") == m, F.col("path"))).alias(f"file{m}") for m in ("1", "2")]
    return parts.groupBy("sample").agg(*files).select(
        "sample", F.lit("fastq").alias("format"), "file1", "file2", F.lit(clip).alias("clip_fwd"), F.lit(clip).alias("clip_rev")
    )


def sequence_manifest(paths: DataFrame, suffix: str = "-nc") -> DataFrame:
    """``(sample, format, file1)`` from ``…/sample/sample-nonchimeras.fasta`` paths, without ``GLOBAL``."""
    sample = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    rows = paths.where(F.col("path").endswith("-nonchimeras.fasta")).select(
        F.concat(sample, F.lit(suffix)).alias("sample"), F.lit("fasta").alias("format"), F.col("path").alias("file1")
    )
    return rows.where("NOT contains(sample, 'GLOBAL')")


def archive_files(accessions: DataFrame, marker: str = "12S") -> DataFrame:
    """Names under which the two files of each archived sample are to be kept."""
    rows = accessions.where(F.col("marker") == marker)
    names = F.array(*[F.concat(F.col("SampleID"), F.lit("-"), F.col("marker"), F.lit(f"_{m}.fastq.gz")) for m in (1, 2)])
    return rows.select("SampleID", "SRA_accession", F.explode(names).alias("file"))
