"""Session set-up, the shared scratch folder and small in-plan tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}


def local_session(cores: int | str = 8, name: str = "taxatally") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", os.environ.get("TAXATALLY_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="taxatally-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str = "table", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Used where a result is read more than once or a loop would grow the lineage:
    the work is done once, survives executor loss, and later joins see its true size.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, schema: str, rows: Iterable[Sequence]) -> DataFrame:
    """Lookup table held in the plan itself, so Spark knows its exact size.

    ``schema`` is ``"name type, name type"``. Joins with it need no hint: Spark
    broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond.
    """
    fields = [part.split() for part in schema.split(",")]
    rows = list(rows)
    arrays = [pa.array([r[i] for r in rows], type=_ARROW[t]) for i, (_, t) in enumerate(fields)]
    return spark.createDataFrame(pa.table(arrays, names=[n for n, _ in fields]))
