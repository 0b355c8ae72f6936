"""Embeddings whitened with MLlib's distributed block matrices.

Rows get an index without gaps, are centred and laid out as blocks of rows. The blocks'
transpose times the blocks is the scatter matrix; its eigenvectors are found on the driver (as
many numbers as dimensions squared) and one more block product projects every row. Rows go
from the table to blocks and back inside the JVM; no block holds more than ``BLOCK`` numbers, and
the middle dimension of a product is split, so no task gets all blocks.

Dimensions of every vector are put on whole numbers first, ``floor(scale * c) + shift``, so sums over
rows are exact in any order. The vectors that take part are those without null or non-finite
components, as long as most of them (ties: the longer); others, null and empty vectors have no rows
in the result. Repeated rows count as often as they stand there and a null id stays null. Components
without variance to speak of (below 1e-12 of the trace) are left out, so one row or equal rows give an
empty result, as an empty table does. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_table, stored

SCALE, SHIFT = 1024, 100_000
#: Numbers in a block (8 MB), and blocks of rows that meet in one task of a product.
BLOCK, TOGETHER = 1 << 20, 8
#: Dimensions up to which the scatter matrix is decomposed on the driver.
MOST_DIMENSIONS = 8192
_NO_VARIANCE = 1e-12


def whole(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, x`` of the rows that take part, ``x`` an array of longs."""
    rows = vectors.select("vec_id", F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(finite)
    return rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * F.lit(float(scale))) + F.lit(shift)).alias("x"))


def indexed(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` with ``row``, a number from 0 without gaps.

    A row knows its place in its partition once it is written; the rows before a partition are
    a sum over one number for each partition.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = stored(rows.select(F.spark_partition_id().alias("part"), place.alias("inside"), F.struct(*rows.columns).alias("kept")), "indexed")
    sizes = [(r.part, r.n) for r in held.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    before = np.cumsum([0, *(n for _, n in sizes)])[:-1].tolist()
    offsets = small_table(rows.sparkSession, "part int, before bigint", [(p, b) for (p, _), b in zip(sizes, before, strict=True)])
    return held.join(offsets, "part").select((F.col("before") + F.col("inside")).alias("row"), "kept.*")


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Blocks of ``row, vector`` (arrays of doubles), rows numbered from 0 to ``n - 1``."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector("vector").alias("vector")), "vector")
    # This is what IndexedRowMatrix does with an RDD of rows, without its way through Python.
    held = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, n, d))
    return held.toBlockMatrix(max(1, BLOCK // d), d)


def product(left: BlockMatrix, right: BlockMatrix) -> BlockMatrix:
    """``left`` times ``right``, the middle dimension split where it is long."""
    splits = max(1, -(-left.numColBlocks // TOGETHER))
    return BlockMatrix(left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits), left.rowsPerBlock, right.colsPerBlock)


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """The transpose of ``blocks`` times ``blocks``: as many rows and columns as dimensions."""
    return product(blocks.transpose(), blocks).toLocalMatrix().toArray()


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, sums, components as columns, their variances and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float


def _array(values: list, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def _centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``row, vector`` with the mean taken off before anything is multiplied."""
    mean = _array([s // n for s in sums], "bigint"), _array([s % n / n for s in sums], "double")
    parts = F.arrays_zip(F.col("x"), mean[0].alias("whole"), mean[1].alias("rest"))
    return rows.select("row", F.transform(parts, lambda p: (p["x"] - p["whole"]).cast("double") - p["rest"]).alias("vector"))


def fit(rows: DataFrame) -> tuple[DataFrame, BlockMatrix, Whitening] | None:
    """Index ``vec_id, x``, find all components; None without rows."""
    sizes = rows.groupBy(F.size("x").alias("d")).count().collect()
    if not sizes:
        return None
    d = max(sizes, key=lambda r: (r["count"], r["d"]))["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS} are decomposed on the driver")
    held = indexed(rows.filter(F.size("x") == d))
    first = held.select(F.count("*").alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d))).first()
    n, sums = first[0], list(first[1:])
    blocks = block_matrix(_centred(held, n, sums), n, d)
    covariance = scatter(blocks) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    order = [i for i in np.argsort(-values, kind="stable") if values[i] > _NO_VARIANCE * max(trace, 0)]
    return held, blocks, Whitening(n, sums, vectors[:, order], values[order], trace)


def projected(blocks: BlockMatrix, matrix: np.ndarray, spark) -> BlockMatrix:
    """Every row times ``matrix``, which is sent as one block."""
    d, k = matrix.shape
    local = DenseMatrix(d, k, matrix.ravel(order="F").tolist())
    return product(blocks, BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), d, k))


def whiten(vectors: DataFrame, most: int = 8, column: str = "embedding") -> DataFrame:
    """One row for each vector and component up to ``most``.

    ``vec_id, component, n, deviation, whitened, explained, identity_error``: ``deviation`` is the
    sum over dimensions of ``(n * x - S)^2``, null where a long can't hold it (then ``deviation_exact``,
    a decimal, has it up to 38 digits); ``identity_error`` is the largest absolute difference of
    the covariance of what was whitened, computed from the rows again, to the identity.
    """
    spark = vectors.sparkSession
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    schema = schema.format(vectors.schema["vec_id"].dataType.simpleString())
    fitted = fit(whole(vectors, column))
    if fitted is None or not len(fitted[2].variances):
        return spark.createDataFrame([], schema)
    held, blocks, w = fitted
    k = min(most, len(w.variances))
    matrix = w.components[:, :k] / np.sqrt(w.variances[:k])
    out = projected(blocks, matrix, spark).toIndexedRowMatrix()
    rows = MLUtils.convertVectorColumnsToML(callMLlibFunc("getIndexedRows", out._java_matrix_wrapper._java_model), "vector")
    white = stored(rows.select(F.col("index").alias("row"), vector_to_array("vector").alias("vector")), "whitened")
    error = float(np.abs(scatter(block_matrix(white, w.n, k)) / w.n - np.eye(k)).max())
    # n times the difference to the mean fits a long; its square may not.
    far = F.transform(F.arrays_zip(F.col("x"), _array(w.sums, "bigint").alias("s")), lambda p: (F.lit(w.n) * p["x"] - p["s"]).cast("decimal(19,0)"))
    exact = F.aggregate(far, F.lit(0).cast("decimal(38,0)"), lambda total, v: (total + v * v).cast("decimal(38,0)"))
    joined = held.select("row", "vec_id", exact.alias("exact")).join(white, "row")
    explained = F.element_at(_array([float(v / w.trace) for v in w.variances[:k]], "double"), F.col("component"))
    cut = joined.select("vec_id", "exact", F.posexplode("vector").alias("place", "whitened")).withColumn("component", (F.col("place") + 1).cast("int"))
    return cut.select(
        "vec_id", "component", F.lit(w.n).cast("long").alias("n"), F.expr("try_cast(exact AS bigint)").alias("deviation"), "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"), F.col("exact").alias("deviation_exact"),
    )
