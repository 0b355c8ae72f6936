"""Sparse observation tables in BIOM (JSON) and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxatally.session import stored
from taxatally.sources.tables import write_count_table

SCHEMA = (
    "id STRING, rows ARRAY<STRUCT<id: STRING, metadata: STRUCT<taxonomy: ARRAY<STRING>>>>, "
    "columns ARRAY<STRUCT<id: STRING>>, data ARRAY<ARRAY<DOUBLE>>"
)


def read_biom(spark: SparkSession, path: str) -> DataFrame:
    """Documents as long rows ``(otu, sample, reads, taxonomy)``.

    A document is one row to begin with and its cells are exploded from it; a large table
    is therefore best kept as several documents, as ``write_biom`` does.
    """
    docs = spark.read.schema(SCHEMA).json(path)
    cells = docs.select("rows", "columns", F.explode("data").alias("cell"))
    row, column = (F.get("cell", F.lit(i)).cast("int") for i in (0, 1))
    return cells.select(
        F.get("rows", row)["id"].alias("otu"),
        F.get("columns", column)["id"].alias("sample"),
        F.get("cell", F.lit(2)).cast("bigint").alias("reads"),
        F.get("rows", row)["metadata"]["taxonomy"].alias("taxonomy"),
    )


def read_biom_file(spark: SparkSession, path: str) -> DataFrame:
    """The same for a single document spread over many lines."""
    return read_biom(spark, _one_line(spark, path))


def _one_line(spark: SparkSession, path: str) -> str:
    from taxatally.session import new_path

    out = new_path(spark, "biom")
    spark.read.text(path, wholetext=True).select(F.translate("value", "\r\n", "  ").alias("value")).write.text(out)
    return out


def write_biom(counts: DataFrame, path: str, cells_per_document: int = 50_000) -> None:
    """Long rows ``(otu, sample, reads[, taxonomy])`` as BIOM documents, one per line.

    Cells are dealt out evenly by a hash of their key, so a sequence or sample with a large
    share of all cells does not make one document large. Every document is complete in
    itself: it lists the rows and columns its cells refer to.
    """
    if "taxonomy" not in counts.columns:
        counts = counts.withColumn("taxonomy", F.lit(None).cast("array<string>"))
    held = stored(counts.select("otu", "sample", "reads", "taxonomy"), "cells")
    documents = max(1, -(-held.count() // cells_per_document))
    dealt = held.withColumn("doc", F.pmod(F.xxhash64("otu", "sample"), F.lit(documents)))
    # Names get their positions by a join, once for each name of a document.
    named = dealt.groupBy("doc", "otu").agg(F.max("taxonomy").alias("taxonomy"))
    otus = stored(named.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("otu", "taxonomy"))).alias("otus")), "otus")
    samples = stored(dealt.groupBy("doc").agg(F.sort_array(F.collect_set("sample")).alias("samples")), "samples")
    rows = otus.select("doc", F.posexplode("otus").alias("row", "o")).select("doc", "row", "o.otu")
    columns = samples.select("doc", F.posexplode("samples").alias("column", "sample"))
    placed = dealt.join(rows, ["doc", "otu"]).join(columns, ["doc", "sample"])
    cells = placed.groupBy("doc").agg(F.collect_list(F.array(F.col("row").cast("bigint"), F.col("column").cast("bigint"), F.col("reads").cast("bigint"))).alias("cells"))
    per = cells.join(otus, "doc").join(samples, "doc")
    document = F.struct(
        F.col("doc").cast("string").alias("id"),
        F.lit("Biological Observation Matrix 1.0.0").alias("format"),
        F.lit("OTU table").alias("type"),
        F.lit("sparse").alias("matrix_type"),
        F.lit("int").alias("matrix_element_type"),
        F.array(F.size("otus"), F.size("samples")).alias("shape"),
        F.transform("otus", lambda o: F.struct(o["otu"].alias("id"), F.struct(o["taxonomy"].alias("taxonomy")).alias("metadata"))).alias("rows"),
        F.transform("samples", lambda s: F.struct(s.alias("id"))).alias("columns"),
        F.col("cells").alias("data"),
    )
    per.select(F.to_json(document).alias("value")).write.text(path)


def write_tsv(counts: DataFrame, path: str, samples: list[str], lineage: bool = True) -> None:
    """Wide tab-separated table with one column per listed sample, and the lineage if wanted."""
    rows = counts.withColumnRenamed("otu", "taxon")
    if lineage:
        rows = rows.withColumn("taxonomy", F.array_join("taxonomy", ";"))
    write_count_table(rows, path, samples, sep="\t", lineage="taxonomy" if lineage else None)


#: A cell at the end of what stands before a closing bracket: row, column and count.
_CELL = r"\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(-?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)\s*$"
_ID = r'"id"\s*:\s*"((?:[^"\\]|\\.)*)"'
_TAXONOMY = r'"taxonomy"\s*:\s*\[((?:\s*"(?:[^"\\]|\\.)*"\s*,?)*)\s*\]'


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """What stands before each ``end`` of a file, with its place: by part of the file, then in it."""
    return spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"
    )


def _numbered(entries: DataFrame) -> DataFrame:
    """Entries with their index in the file; one sum for each part of the file, no window over all."""
    parts = stored(entries.groupBy("block").agg(F.count("*").alias("n")), "parts")
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    return entries.withColumn("own", own).join(parts.select("block", before.alias("before")), "block").withColumn("index", (F.col("before") + F.col("own")).cast("int")).drop("own", "before")


def read_large_biom(spark: SparkSession, path: str) -> DataFrame:
    """One large document as long rows ``(otu, sample, reads, taxonomy)``, read by as many tasks as it has parts.

    The file is cut at closing brackets wherever Spark splits it, so cells need no whole document
    in one place; names are cut at closing braces, numbered by their place in the file and joined. The
    document must be sparse. One whose names hold braces, or that breaks the form otherwise, gives other
    names than its ``shape`` says, which is an error; ``read_biom_file`` reads it.
    """
    cells = _pieces(spark, path, "]").select(F.regexp_extract_all("value", F.lit(_CELL), F.lit(0)).alias("cell"), "value").where(F.size("cell") > 0)
    part = lambda i: F.regexp_extract("value", _CELL, i)
    cells = cells.select(part(1).cast("int").alias("row"), part(2).cast("int").alias("column"), part(3).cast("double").cast("bigint").alias("reads"))
    named = _pieces(spark, path, "}")
    # The key that opens a list stands in the piece of its first entry.
    marks = named.select("block", "at", F.col("value").rlike(r'"rows"\s*:\s*\[').alias("rows"), F.col("value").rlike(r'"columns"\s*:\s*\[').alias("columns"))
    places = marks.where("rows or columns").agg(F.min(F.when(F.col("rows"), F.struct("block", "at"))).alias("rows"), F.min(F.when(F.col("columns"), F.struct("block", "at"))).alias("columns")).first()
    shape = _pieces(spark, path, "]").select(F.regexp_extract("value", r'"shape"\s*:\s*\[\s*(\d+)\s*,\s*(\d+)\s*$', 1).alias("n"), F.regexp_extract("value", r'"shape"\s*:\s*\[\s*(\d+)\s*,\s*(\d+)\s*$', 2).alias("m")).where("n <> ''").first()
    if not (places and places["rows"] and places["columns"] and shape):
        raise ValueError("not a sparse table with rows, columns and a shape")
    here = F.struct("block", "at")
    at = {k: F.struct(F.lit(places[k]["block"]).cast("bigint").alias("block"), F.lit(places[k]["at"]).cast("bigint").alias("at")) for k in ("rows", "columns")}
    first, second = ("rows", "columns") if tuple(places["rows"]) < tuple(places["columns"]) else ("columns", "rows")
    # The id of the document itself stands before both lists, in the piece that opens the first one.
    entries = named.withColumn("value", F.regexp_replace("value", r'(?s)^.*"(?:rows|columns)"\s*:\s*\[', "")).where(F.col("value").rlike(r'^[\s,]*\{\s*"id"|^[\s,]*\{.*"id"\s*:'))
    tables = {}
    for name, inside, size in ((first, here < at[second], shape["n" if first == "rows" else "m"]), (second, here >= at[second], shape["n" if second == "rows" else "m"])):
        found = _numbered(entries.where((here >= at[first]) & inside))
        found = stored(found.select("index", F.regexp_replace(F.regexp_extract("value", _ID, 1), r"\\(.)", "$1").alias("id"), F.regexp_extract("value", _TAXONOMY, 1).alias("taxonomy"), F.col("value").rlike(_TAXONOMY).alias("named"), F.col("value").rlike(_ID).alias("whole")), name)
        if found.count() != int(size) or not found.where(~F.col("whole")).isEmpty():
            raise ValueError(f"{name} can't be told apart; read the document whole")
        tables[name] = found
    names = F.when(F.col("named"), F.transform(F.regexp_extract_all("taxonomy", F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1)), lambda x: F.regexp_replace(x, r"\\(.)", "$1")))
    rows = tables["rows"].select(F.col("index").alias("row"), F.col("id").alias("otu"), names.alias("taxonomy"))
    columns = tables["columns"].select(F.col("index").alias("column"), F.col("id").alias("sample"))
    return cells.join(rows, "row").join(columns, "column").select("otu", "sample", "reads", "taxonomy")
