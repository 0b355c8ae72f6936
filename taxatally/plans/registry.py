"""Catalogue of named queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """Lazy access to the given parquet tables as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        """Run SQL whose ``{table}`` placeholders stand for the given tables or views."""
        used = {name: getattr(self, name) for name in TABLES if "{" + name + "}" in text}
        return self.spark.sql(text, **used, **views)


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under a name, with the SQL text of the expected result."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"query {name} is registered twice")
        text = sql.format_map({t: t for t in TABLES}) if sql is not None else None
        CATALOGUE[name] = Query(name, build, text)
        return build

    return register
