"""Operator 12: whitening of embeddings with distributed block matrices of Spark's MLlib."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import stored

#: Steps of a component in one unit.
STEPS = 256
#: Rows and columns of a block.
ROWS, COLUMNS = 1024, 256
#: Parts that a sum over blocks is cut into, so that the blocks of a column don't meet in one task.
MIDDLE = 64


def on_grid(df: DataFrame, key: str = "vec_id", vector: str = "embedding", steps: int = STEPS) -> DataFrame:
    """(_key, x): the rows whose vector is there, without null or non-finite entries, as whole steps (floor)."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.where(usable).select(
        F.col(key).alias("_key"), F.transform(v, lambda c: F.floor(c.cast("double") * steps).cast("long")).alias("x")
    )


def padded(rows: DataFrame, dims: int) -> DataFrame:
    """Every vector with ``dims`` components; those that a shorter one lacks are 0."""
    missing = F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))
    return rows.withColumn("x", F.when(F.size("x") < dims, F.concat("x", missing)).otherwise(F.col("x")))


def numbered(rows: DataFrame) -> DataFrame:
    """Stored rows with a number ``i`` from 0 without gaps: their place in their part, after the rows of earlier parts."""
    placed = rows.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    placed = stored(placed, "numbered")
    # One line for each part that was written.
    parts = placed.groupBy("_part").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).collect()
    shifts, at = [], 0
    for part, first, n in sorted(map(tuple, parts)):
        shifts.append((part, at - first))
        at += n
    shift = placed.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    return placed.join(shift, "_part").withColumn("i", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def sums_of(rows: DataFrame) -> tuple[int, list[int], int]:
    """The number of vectors, the sum of each component and the largest magnitude: a line for each component."""
    exact = F.col("c").cast("decimal(28,0)")
    lines = (
        rows.select(F.posexplode("x").alias("p", "c"))
        .groupBy("p")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(exact).alias("s"), F.max(F.abs(exact)).alias("most"))
        .collect()
    )
    lines.sort()
    return max((r["n"] for r in lines), default=0), [int(r["s"]) for r in lines], max((int(r["most"]) for r in lines), default=0)


def centred_matrix(rows: DataFrame, means: list[float]) -> BlockMatrix:
    """Rows (i, x) less the means, dealt into blocks."""
    less = F.array(*[F.lit(float(m)) for m in means])
    vector = array_to_vector(F.zip_with(F.col("x"), less, lambda c, m: c.cast("double") - m))
    dense = MLUtils.convertVectorColumnsFromML(rows.select("i", vector.alias("vector")), "vector")
    return IndexedRowMatrix(dense).toBlockMatrix(ROWS, COLUMNS)


def _product(a: BlockMatrix, b: BlockMatrix) -> BlockMatrix:
    """a times b, the sum over inner blocks cut into parts (which Python's ``multiply`` does not offer)."""
    inner = -(-a.numCols() // a.colsPerBlock)
    model = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, int(min(MIDDLE, inner)))
    return BlockMatrix(model, a.rowsPerBlock, b.colsPerBlock)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The matrix's transpose times itself: its side is the number of components, so it is held by the driver."""
    return _product(matrix.transpose(), matrix).toLocalMatrix().toArray()


def whitening_matrix(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, matrix): unit eigenvectors by falling eigenvalue, each over its eigenvalue's root.

    Components along which nothing varies are left out.  A vector's largest entry is positive.
    """
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    some = values > len(covariance) * np.finfo(float).eps * max(values[0], 0)
    values, vectors = values[some], vectors[:, some]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    return values, vectors / np.sqrt(values)


def projected(matrix: BlockMatrix, onto: np.ndarray, df: DataFrame) -> BlockMatrix:
    """The matrix times a small one, which is cut into blocks of its rows."""
    parts = np.split(onto, range(COLUMNS, len(onto), COLUMNS))
    blocks = [((k, 0), Matrices.dense(*part.shape, part.ravel(order="F").tolist())) for k, part in enumerate(parts)]
    small = df.sparkSession.sparkContext.parallelize(blocks, len(blocks))
    return _product(matrix, BlockMatrix(small, COLUMNS, onto.shape[1]))


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """(i, y): the rows of a matrix whose columns fit in one block."""
    indexed = matrix.toIndexedRowMatrix()  # named, as the JVM's side of it goes with the last reference
    rows = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("i"), vector_to_array("vector").alias("y"))


def deviation(n: int, sums: list[int], most: int) -> Column:
    """The sum over components of (n x - sum)^2, exactly; null where that doesn't fit a long.

    Longs where the largest magnitude shows that nothing overflows, else decimals of 38 digits.
    """
    fits = len(sums) * (n * most + max(map(abs, sums))) ** 2 < 1 << 63
    kind = "long" if fits else "decimal(38,0)"
    whole = lambda c: c if fits else c.try_cast(kind)
    of = F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    apart = F.zip_with("x", of, lambda x, s: whole(F.try_subtract(whole(F.try_multiply(F.lit(n).cast(kind), x.cast(kind))), s)))
    total = F.aggregate(
        apart, F.lit(0).cast(kind), lambda t, a: whole(F.try_add(t, whole(F.try_multiply(a, a))))
    )
    return total.try_cast("long")


def whitened(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, steps: int = STEPS
) -> DataFrame:
    """The first ``components`` whitened components of every usable row.

    Vectors become whole steps.  The distinct ones, each once, however often it occurs, are the fit list: centred, dealt
    into blocks, and multiplied by their transpose for the scatter, whose eigenvectors come from a local
    decomposition (its side is the number of vector components).  All rows, centred and dealt into blocks, are then
    multiplied by the whitening matrix.

    Returns (key, component, n, deviation, whitened, explained, identity_error), a line for each row and component
    (from 1): size of the fit list, the row's exact sum of (n x - sum)^2 (null where it doesn't fit a long), its
    whitened component, the component's share of the variance, and the largest entry by which the covariance of the fit
    list's whitened components departs from the identity.

    Rows whose vector is null, or has a null or non-finite entry, go.  Shorter vectors end in zeros.  Repeated rows
    stay, with one key or without a key too.  Components along which nothing varies are left out, so a table with fewer
    than two distinct vectors gives an empty result.  Only the named columns are read.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = stored(on_grid(df, key, vector, steps), "vectors")
    dims = rows.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return spark.createDataFrame([], schema)
    rows = padded(rows, dims)
    fit = numbered(rows.select("x").distinct())
    n, sums, most = sums_of(fit)
    means = [s / n for s in sums]
    matrix = centred_matrix(fit, means)
    covariance = scatter(matrix) / n
    values, onto = whitening_matrix(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    error = float(np.abs(scatter(projected(matrix, onto, df)) / n - np.eye(len(values))).max())
    every = numbered(rows)
    ends = rows_of(projected(centred_matrix(every, means), onto, df))
    share = F.array(*[F.lit(float(v)) for v in values / np.trace(covariance)])
    one = every.select("_key", "i", deviation(n, sums, most).alias("deviation")).join(ends, "i")
    return one.select("_key", "deviation", F.posexplode("y").alias("p", "whitened")).select(
        F.col("_key").alias(key),
        (F.col("p") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, "p").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
