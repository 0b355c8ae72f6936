"""Queries of the operators for training data: each applies one of them to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, bpe, chat, html_text, line_dedup, mixing, ngram_join, passages, quality, tokens, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@op
def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(table(spark, folder, "documents"), n=4, percent=85)


ORACLES["op1_ngram_join"] = ngram_join.linked_sql(n=4, percent=85)


@op
def op2_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.round_trip(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@op
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@op
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), weights=(1, 2, 3), most=3)


@op
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeats(table(spark, folder, "documents"))


@op
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.pages(table(spark, folder, "pages"))


ORACLES["op6_line_dedup"] = line_dedup.pages_sql()


@op
def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return ann.divisible(table(spark, folder, "embeddings"))


@op
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.measure(table(spark, folder, "documents"))


ORACLES["op8_quality_rules"] = quality.SQL


@op
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


@op
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.conversations(table(spark, folder, "conversations"))


ORACLES["op10_chat"] = chat.SQL


@op
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@op
def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@op
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.scored(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
