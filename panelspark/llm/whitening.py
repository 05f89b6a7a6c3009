"""Whitening of embeddings with the distributed block matrices of Spark MLlib.

Entries are taken as whole numbers x, so that the mean S/n of the n different vectors and each row's
distance from it, (n x - S)/n, are exact before the one division. The centred rows are indexed and put
into blocks; blocks of rows times their transposes add up to the scatter matrix, whose eigenvectors are
found on the driver, and one more product of blocks projects the rows. Everything but the square of the
dimension stays in the JVM's tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch

SCALE, SHIFT, KEPT = 64, 1_000_000, 16
#: Numbers of a block.
BLOCK = 524_288
#: Whole numbers are held to this size.
_MOST = 2**60


def whole_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): floor(SCALE * component) + SHIFT of each vector without null or non-finite components, as longs."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.least(F.greatest(F.floor(c.cast("double") * SCALE).cast("long"), F.lit(-_MOST)), F.lit(_MOST)) + SHIFT
    return vectors.filter(usable).select("vec_id", F.transform("embedding", scaled).alias("x"))


def _indexed(rows: DataFrame) -> DataFrame:
    """rows, a saved table with part and place, with index: dense from 0. The driver sees a number a part."""
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    first = np.cumsum([0, *[n for _, n in counts]]).tolist()
    starts = rows.sparkSession.createDataFrame([(p, f) for (p, _), f in zip(counts, first, strict=False)], "part int, _first long")
    return rows.join(F.broadcast(starts), "part").withColumn("index", F.col("_first") + F.col("place")).drop("_first", "part", "place")


def _placed(df: DataFrame) -> DataFrame:
    """df with its task's number and the place in it, to be saved at once."""
    return df.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})


def block_matrix(rows: DataFrame, n: int, length: int) -> BlockMatrix:
    """Blocks of the rows (index, centred)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, length).toBlockMatrix(max(1, BLOCK // length), length)


def squared(a: BlockMatrix, splits: int) -> np.ndarray:
    """The transpose of a times a. Its one block is the sum of as many parts as splits, so that no task has all rows."""
    found = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def _rows_of(a: BlockMatrix) -> DataFrame:
    """(index, values) of a block matrix's rows."""
    rows = callMLlibFunc("getIndexedRows", a.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("values"))


def axes(scatter: np.ndarray, n: int, kept: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors as columns, and eigenvalues from the largest on, of scatter / n, kept at most; and its trace.
    Directions without variance beyond rounding are left out."""
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    trace = float(np.trace(scatter)) / n
    order = np.argsort(-values, kind="stable")[:kept]
    order = order[values[order] > max(trace, 0.0) * len(values) * 1e-14]
    return vectors[:, order], values[order], trace


def whiten(vectors: DataFrame, kept: int = KEPT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each row's projections on the kept first
    principal axes of the different rows, over the root of the axis' variance.

    A component c counts as floor(64 c) + 1000000, held to 2^60. n is the number of different rows. deviation is the sum of
    (n x - S)^2 over the dimensions, NULL if that is beyond longs; identity_error is the largest
    entry of the covariance of whitened less the identity, over the different rows. An axis has either sign, the same in
    all rows; axes without variance aren't given, so a table of equal rows has no result. Rows with a null vector, or with
    null or non-finite components, are left out; a null vec_id stays null, and repeated rows have equal results. A
    shorter vector, the empty one too, counts as one that ends in zeros. Other columns are ignored. Empty tables give an
    empty result. The covariance, as large as the dimension squared, is on the driver.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    nothing = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = whole_rows(vectors)
    size = rows.agg(F.max(F.size("x")).alias("length"), F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most")).first()
    length = size["length"] or 0
    if not length:
        return nothing
    least, most = min(size["least"], SHIFT), max(size["most"], SHIFT)
    padded = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(length) - F.size("x")))
    rows = rows.withColumn("x", padded)
    fit = scratch.save(_placed(rows.select("x").distinct()), "fit")
    n = fit.count()
    fits, farthest = n * max(-least, most) < 2**62, n * (most - least)
    value = F.col("v") if fits else F.col("v").cast("decimal(20,0)")
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(value).alias("s")).orderBy("i").collect()  # a row a dimension
    total = F.array(*[F.lit(int(r["s"])).cast("long") if fits else F.lit(r["s"]).cast("decimal(38,0)") for r in sums])
    kind = "long" if fits else "decimal(38,0)"
    apart = F.transform(F.arrays_zip(F.col("x").alias("x"), total.alias("s")), lambda z: (F.lit(n).cast(kind) * z["x"].cast(kind) - z["s"]).cast(kind))
    centred = F.transform("apart", lambda v: v.cast("double") / F.lit(float(n)))
    wide = F.transform("apart", lambda v: v.cast("decimal(18,0)") * v.cast("decimal(18,0)"))
    if fits and farthest**2 * length < 2**63:
        deviation = F.aggregate("apart", F.lit(0).cast("long"), lambda a, v: a + v * v)
    elif fits and farthest < 10**18:
        deviation = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)")).try_cast("long")
    else:
        deviation = F.lit(None).cast("long")
    fit = _indexed(fit).withColumn("apart", apart).select("index", centred.alias("centred"))
    splits = max(1, min(-(-n // max(1, BLOCK // length)), 4 * spark.sparkContext.defaultParallelism))
    matrix = block_matrix(fit, n, length)
    vectors_, values, trace = axes(squared(matrix, splits), n, kept)
    if not len(values):
        return nothing
    matrix_of = vectors_ / np.sqrt(values)
    whitener = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(length, len(values), matrix_of.ravel(order="F")))], 1), length, len(values), length, len(values))
    error = float(np.abs(squared(matrix.multiply(whitener), splits) / n - np.eye(len(values))).max())
    all_rows = scratch.save(_placed(rows.withColumn("apart", apart).select("vec_id", deviation.alias("deviation"), centred.alias("centred"))), "rows")
    held = all_rows.count()
    all_rows = _indexed(all_rows)
    projected = scratch.save(_rows_of(block_matrix(all_rows, held, length).multiply(whitener)), "projected")
    out = all_rows.select("vec_id", "index", "deviation").join(projected, "index")
    out = out.select("vec_id", "deviation", F.posexplode("values").alias("at", "whitened"))
    share: Column = F.array(*[F.lit(float(e / trace)) for e in values])
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
