"""FASTA and FASTQ files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxatally.functions.sequences import phred

#: Reads in one FASTQ file that is written.
MOST_READS = 1 << 15


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records ``(id, description, seq)``; wrapped sequences are joined.

    Records are separated inside the scan, so large files are read in parallel.
    """
    raw = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>|\r", "").alias("record"))
    header = F.substring_index("record", "\n", 1)
    body = F.expr("substring(record, length(substring_index(record, '\\n', 1)) + 1)")
    return raw.where(F.length(F.trim("record")) > 0).select(
        F.regexp_extract(header, r"^(\S+)", 1).alias("id"),
        F.regexp_extract(header, r"^\S+\s+(.*)$", 1).alias("description"),
        F.regexp_replace(body, r"\s", "").alias("seq"),
    )


def fasta_record(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def write_fasta(df: DataFrame, path: str, name: str = "id", seq: str = "seq") -> None:
    """One record per row, one file per partition."""
    df.select(fasta_record(F.col(name), F.col(seq)).alias("value")).write.text(path)


def fastq_record(name: Column, seq: Column, qual: Column) -> Column:
    """Four lines of a read from its sequence and its array of qualities."""
    text = F.array_join(F.transform(qual, lambda q: F.char(q + 33)), "")
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), text)


def write_fastq(df: DataFrame, path: str, compression: str = "gzip", most: int = MOST_READS) -> None:
    """Rows ``(read_id, seq, qual)`` as FASTQ.

    A compressed file is read by one task, so a file holds ``most`` reads at most.
    """
    records = df.select(fastq_record(F.col("read_id").cast("string"), F.col("seq"), F.col("qual")).alias("value"))
    records.write.option("maxRecordsPerFile", most).text(path, compression=compression)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Reads ``(file, read_id, seq, qual)`` from FASTQ files, plain or compressed.

    A quality line may begin with ``@``, so only line numbers tell lines apart. They are
    put together from the number of lines in each part of a file and the row's place in
    its part, so no file passes through one task. The four lines of a read usually sit in
    one partition and are joined before the shuffle. A file goes by the number of its first row
    there, and the third line isn't needed, so neither paths nor those lines are sorted.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.rtrim("value").alias("value"),
    )
    parts = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count("*").alias("size"))
    running = F.sum("size").over(Window.partitionBy("file").orderBy("block"))
    number = F.min("first").over(Window.partitionBy("file"))
    starts = parts.select("file", "block", number.alias("number"), (running - F.col("size") - F.col("first")).alias("shift"))
    numbered = lines.join(starts, ["file", "block"]).withColumn("line", F.col("row") + F.col("shift"))
    place = F.col("line") % 4

    def at(k: int, column: str = "value") -> Column:
        return F.max(F.when(place == k, F.col(column)))

    records = numbered.where(place != 2).groupBy("number", F.floor(F.col("line") / 4).alias("record")).agg(
        at(0, "file").alias("file"), at(0).alias("header"), at(1).alias("seq"), at(3).alias("quality")
    )
    return records.where(F.col("seq").isNotNull()).select(
        "file", F.regexp_extract("header", r"^@(\S+)", 1).alias("read_id"), "seq", phred("quality").alias("qual")
    )
