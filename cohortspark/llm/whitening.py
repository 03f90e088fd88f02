"""Whitening of embeddings with distributed block matrices.

The distinct vectors, centred, are indexed rows; `toBlockMatrix` deals them into blocks. The transposed matrix
times itself is the scatter, one block of width x width, whose eigenvectors are found on the driver. A second
product with the whitening matrix projects the rows, and what the projected distinct vectors give for a covariance
is compared with the identity.

Vectors become whole numbers first, so sums are exact. The driver holds matrices of width x width only, and one
number a block, which the block product needs; a block holds `rows_per_block` rows.
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

from cohortspark.llm.common import stored
from cohortspark.llm.va_file import is_finite

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
ROWS_PER_BLOCK = 2048
#: Whole numbers beyond this are set to it before the shift.
LIMIT = 1 << 30
LONG = (1 << 63) - 1
#: Eigenvalues below this share of the largest one are rounding, not variance.
LEAST_VARIANCE = 1e-12
_WITHIN = (1 << 33) - 1  # the bits of monotonically_increasing_id that count inside a partition


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift for every component of the vectors without null or non-finite ones."""
    vector = F.col(vector_col)
    good = vectors.where(is_finite(vector) & (F.size(vector) > 0))
    x = F.transform(
        vector.cast("array<double>"),
        lambda c: (F.floor(F.greatest(F.least(c * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))) + shift).cast("int"),
    )
    return good.select(F.col(id_col).alias("vec_id"), x.alias("x"))


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows, stored with a number of their own in `at`."""
    return stored(rows.withColumn("at", F.monotonically_increasing_id()), name)


@dataclass
class Moments:
    """Number of distinct vectors, and the sum, least and greatest of each dimension."""

    n: int
    sums: list[int]
    least: list[int]
    greatest: list[int]

    @classmethod
    def of(cls, distinct: DataFrame) -> Moments:
        rows = distinct.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(
            F.count("v").alias("n"), F.sum(F.col("v").cast("long")).alias("s"), F.min("v").alias("least"), F.max("v").alias("greatest")
        )
        rows = sorted(rows.collect(), key=lambda r: r["d"])  # one row a dimension
        n = rows[0]["n"] if rows else 0
        return cls(n, [r["s"] for r in rows], [r["least"] for r in rows], [r["greatest"] for r in rows])

    def _apart(self, kind: str) -> Column:
        """n * x - S for each dimension: exact."""
        sums = F.array(*[F.lit(s).cast(kind) for s in self.sums])
        return F.zip_with("x", sums, lambda x, s: x.cast(kind) * F.lit(self.n).cast(kind) - s)

    def centred(self) -> Column:
        # n * x fits a long for 2**31 vectors with components at the limit, and for 2**43 with ordinary ones
        return F.transform(self._apart("bigint"), lambda d: d.cast("double") / F.lit(float(self.n)))

    def deviation(self) -> Column:
        """Sum over dimensions of (n * x - S)^2, exact; sums beyond a long stay at its end."""
        most = sum(max(abs(self.n * v - s) for v in (a, b)) ** 2 for s, a, b in zip(self.sums, self.least, self.greatest))
        if most <= LONG:
            return F.aggregate(self._apart("bigint"), F.lit(0).cast("bigint"), lambda total, d: total + d * d)
        about = F.aggregate(self._apart("double"), F.lit(0.0), lambda total, d: total + d * d)
        exact = F.aggregate(
            self._apart("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"), lambda total, d: (total + d * d).cast("decimal(38,0)")
        )
        return F.when(about > 1.0e19, F.lit(LONG)).otherwise(F.least(exact, F.lit(LONG).cast("decimal(38,0)")).cast("bigint"))


def block_matrix(rows: DataFrame, moments: Moments, rows_per_block: int) -> tuple[BlockMatrix, int]:
    """The centred rows of a stored, numbered table as blocks; and the step between partitions in their row index.

    The index leaves gaps behind each partition, so that no count of a partition is needed; gaps have no blocks.
    """
    partition, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit(_WITHIN))
    last = rows.agg(F.max(partition).alias("p"), F.max(within).alias("w")).first()
    step = -(-(last["w"] + 1) // rows_per_block) * rows_per_block
    indexed = rows.select((partition * F.lit(step) + within).alias("index"), array_to_vector(moments.centred()).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(indexed, "vector"), (last["p"] + 1) * step, len(moments.sums))
    return matrix.toBlockMatrix(rows_per_block, len(moments.sums)), step


def inner_product(matrix: BlockMatrix, tasks: int) -> np.ndarray:
    """The transposed matrix times itself: its row blocks are multiplied and summed in `tasks` tasks, then their sums.

    The wrapper is called for that number, which `BlockMatrix.multiply` does not take: with its one the whole
    product would be one task.
    """
    parts = max(1, min(matrix.numRowBlocks, tasks))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def whitening_matrix(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(width x k matrix, share of the variance) of the components with variance, by falling eigenvalue."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    kept = values > LEAST_VARIANCE * max(values[0], 0) if len(values) else np.zeros(0, bool)
    values, vectors = values[kept], vectors[:, kept]
    trace = float(np.trace(covariance))
    return vectors / np.sqrt(values), values / trace if trace else values


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    scale: int = SCALE,
    shift: int = SHIFT,
    rows_per_block: int = ROWS_PER_BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row a vector and component.

    Vectors that are null, empty, or hold null or non-finite components go. Of several widths the most frequent
    one is taken (the larger of equals), the others go as well. The fit takes each distinct vector once; repeated
    rows and null ids stay and are projected. Components without variance have no rows, so equal vectors alone,
    or an empty table, give an empty result. Values beyond `LIMIT` are set to it. Other columns are ignored.
    The width must allow a width x width matrix on the driver.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, scale, shift)
    kind = rows.schema["vec_id"].dataType.simpleString()
    width = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    empty = spark.createDataFrame(
        [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    if not width:
        return empty
    rows = numbered(rows.where(F.size("x") == width[0]["w"]), "vectors")
    distinct = numbered(rows.select("x").distinct(), "distinct")
    moments = Moments.of(distinct)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fit, _ = block_matrix(distinct, moments, rows_per_block)
    projection, explained = whitening_matrix(inner_product(fit, tasks), moments.n, components)
    k = projection.shape[1]
    if k == 0:
        return empty
    block = DenseMatrix(*projection.shape, projection.ravel(order="F").tolist())
    projection = BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), len(moments.sums), k)

    # the columns of the projected fit list are centred as its rows are
    of_fit = inner_product(fit.multiply(projection), tasks) / moments.n
    error = float(np.abs(of_fit - np.eye(k)).max())

    matrix, step = block_matrix(rows, moments, rows_per_block)
    projected = matrix.multiply(projection).toIndexedRowMatrix()
    # the rows as a DataFrame; the property `rows` would send each of them through Python
    projected = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    projected = projected.select("index", vector_to_array("vector").alias("whitened"))
    index = F.shiftright("at", 33) * F.lit(step) + F.col("at").bitwiseAND(F.lit(_WITHIN))
    wide = rows.select("vec_id", index.alias("index"), moments.deviation().alias("deviation")).join(projected, "index")
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(moments.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
