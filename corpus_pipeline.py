"""From raw documents to encoded training rows, in stages that each read what was written before.

Quality rules, lines that a source repeats on its documents, near copies (five words, similarity of
0.8 or more; one document of each group stays), a mix of the sources by weight, and BPE.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxatally.llm import bpe, line_dedup, mixing, ngram_join, quality
from taxatally.session import stored

#: What makes two documents near copies, before lines are cut and after.
NEAR_COPIES = {"n": 5, "percent": 80}

#: Share of a source's documents that makes a line boilerplate. A source is wider than a host: what is
#: repeated on purpose stands in 9 to 14 of 100 documents (sf0.1), the next line in 6 at most.
SOURCE_RATIO = 0.07


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.passing(docs)


def line_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the lines that more than ``SOURCE_RATIO`` of their source's documents hold.

    Near copies count as one document, by the classes that the next stage would find, so what only
    they share is not cut from all of them.
    """
    families = stored(ngram_join.families(docs, **NEAR_COPIES), "families")
    out = line_dedup.drop_boilerplate(docs, F.col("source"), SOURCE_RATIO, families=families)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copy_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs, **NEAR_COPIES)


def mixing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs, weights=(1, 2, 3), most=3)


def bpe_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document of the mix."""
    rows = bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: The draws of the mix and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; what a stage gives is written before the next reads it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name.split()[0])
    return STAGES[-1][1](spark, docs, folder)
