"""Whitening of embeddings by distributed block matrices.

Components become integers, so counts, sums and the mean are exact. The centred rows are indexed and
dealt into a BlockMatrix; its transpose times itself is the scatter, with the middle dimension split
so that many tasks add up parts of it; the scatter's eigenvectors are found on the driver (its size is
the dimension squared, whatever the number of rows); a second BlockMatrix product projects all rows on
the leading eigenvectors over the root of their eigenvalues.

Rows get their index from a written table: its parts are counted and the counts summed, so no row
passes a single task. The covariance of what comes out is measured and its distance from the
identity returned.

Defined results: vectors that are null, empty or hold null or non-finite entries are left out, and
so are those of another dimension than the most frequent one (the larger one, if tied); rows with a
null or repeated vec_id are rows like others; components whose eigenvalue is not above rounding
error of the largest one do not exist, so equal rows or a single row give no rows; fewer dimensions
than components give as many as there are; an empty table gives an empty result; entries so large
that floor(scale * c) has over 42 bits raise; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import broadcast_if_small, finite_vector, with_base, written

RESULT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class WhiteningOptions:
    """x = floor(scale * c) + offset; blocks of at most `block_bytes` of doubles."""

    components: int = 8
    scale: float = 1024.0
    offset: int = 100_000
    block_bytes: int = 8 << 20
    least_rows: int = 256
    block_columns: int = 1024


@dataclass(frozen=True)
class Fit:
    """n rows with exact sums per dimension; eigenvalues in falling order and their eigenvectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_vectors(vectors: DataFrame, options: WhiteningOptions, id_col: str = "vec_id", col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, x as longs, and their dimension (0 where there are none)."""
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(col).cast("array<double>").alias("c")).where(finite_vector(F.col("c")))
    sizes = fine.groupBy(F.size("c").alias("dim")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    dim = sizes["dim"] if sizes else 0
    too_large = F.raise_error(F.lit("a component is too large for exact sums")).cast("long")
    x = F.transform("c", lambda c: F.when(F.abs(c * options.scale) < float(1 << 42), F.floor(c * options.scale).cast("long") + options.offset).otherwise(too_large))
    return fine.where(F.size("c") == dim).select("vec_id", x.alias("x")), dim


def indexed(rows: DataFrame) -> DataFrame:
    """The rows as a written table with `index`, 0 to n - 1."""
    at = F.monotonically_increasing_id()
    placed = written(rows.select("*", F.shiftrightunsigned(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_row")), "whitening-rows")
    parts = with_base(placed.groupBy("_part").agg(F.count("*").alias("_rows")), "_part", "_rows").select("_part", "base")
    return placed.join(broadcast_if_small(parts, parts.count(), 16), "_part").select(*rows.columns, (F.col("base") + F.col("_row")).alias("index"))


def exact_sums(rows: DataFrame, dim: int) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and per dimension the sum, smallest and largest x; summed by batch, then by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch.column(0).flatten(), np.int64).reshape(-1, dim)
                columns = [np.arange(dim), np.full(dim, len(x)), x.sum(0), x.min(0), x.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pos", "n", "total", "low", "high"])

    parts = rows.select("x").mapInArrow(run, "pos bigint, n bigint, total bigint, low bigint, high bigint")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    found = parts.groupBy("pos").agg(F.sum("n").alias("n"), total.alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("pos").collect()
    return found[0]["n"], [int(r["total"]) for r in found], [r["low"] for r in found], [r["high"] for r in found]


def deviations(rows: DataFrame, n: int, sums: list[int], low: list[int], high: list[int]) -> DataFrame:
    """index, vec_id, deviation: the exact sum of (n x - S)^2 over the dimensions."""
    most = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(low, high, sums))
    dim, narrow = len(sums), most * most * len(sums) < 1 << 63 and max(map(abs, sums)) < 1 << 62
    kind = pa.decimal128(38, 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten(), np.int64).reshape(-1, dim)
            if narrow:
                away = n * x - np.array(sums, np.int64)
                found = pa.array((away * away).sum(1)).cast(pa.decimal128(19, 0)).cast(kind)
            else:  # beyond 63 bits: whole numbers of any size
                away = n * x.astype(object) - np.array(sums, object)
                found = pa.array([Decimal(int(v)) for v in (away * away).sum(1)], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["index", "vec_id", "deviation"])

    return rows.select("index", "vec_id", "x").mapInArrow(run, "index bigint, vec_id bigint, deviation decimal(38,0)")


def centred_blocks(rows: DataFrame, n: int, sums: list[int], options: WhiteningOptions) -> BlockMatrix:
    """The rows minus their mean as a BlockMatrix, one block row per `rows_per_block` indexes."""
    dim = len(sums)
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    largest = max(1, options.block_bytes // (8 * min(dim, options.block_columns)))
    rows_per_block = min(largest, max(options.least_rows, n // (4 * tasks)))
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = F.zip_with("x", mean, lambda x, m: x.cast("double") - m)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, dim).toBlockMatrix(rows_per_block, min(dim, options.block_columns))


def scatter(centred: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix. Its middle dimension is all rows: splits of it are summed by tasks of their own."""
    splits = 1 + (centred.numRows() // centred.rowsPerBlock) // 4
    turned = centred.transpose()
    product = turned._java_matrix_wrapper.call("multiply", centred._java_matrix_wrapper._java_model, int(splits))
    return BlockMatrix(product, turned.rowsPerBlock, centred.colsPerBlock).toLocalMatrix().toArray()


def fitted(rows: DataFrame, n: int, sums: list[int], options: WhiteningOptions) -> tuple[BlockMatrix, Fit]:
    centred = centred_blocks(rows, n, sums, options)
    covariance = scatter(centred) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(options.components, int((values > values[0] * len(values) * 1e-15).sum())) if values[0] > 0 else 0
    return centred, Fit(n, sums, values[:count], vectors[:, :count], float(np.trace(covariance)))


def projected(centred: BlockMatrix, fit: Fit, spark) -> DataFrame:
    """index, w: all rows times the whitening matrix."""
    across, count = centred.colsPerBlock, len(fit.values)
    whitening = fit.vectors / np.sqrt(fit.values)
    parts = [whitening[start : start + across] for start in range(0, len(whitening), across)]
    blocks = [((i, 0), DenseMatrix(len(p), count, p.ravel(order="F"))) for i, p in enumerate(parts)]
    product = centred.multiply(BlockMatrix(spark.sparkContext.parallelize(blocks, 1), across, count, len(whitening), count))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("w"))


def identity_error(white: DataFrame, count: int) -> float:
    """Largest entry of the covariance of column w minus the identity."""
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    found = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whiten(vectors: DataFrame, options: WhiteningOptions = WhiteningOptions(), id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every row that takes part."""
    spark = vectors.sparkSession
    whole, dim = whole_vectors(vectors, options, id_col, col)
    if not dim:
        return spark.createDataFrame([], RESULT)
    rows = indexed(whole)
    n, sums, low, high = exact_sums(rows, dim)
    centred, fit = fitted(rows, n, sums, options)
    if not len(fit.values):
        return spark.createDataFrame([], RESULT)
    white = written(deviations(rows, n, sums, low, high).join(projected(centred, fit, spark), "index").select("vec_id", "deviation", "w"), "whitened")
    error = identity_error(white, len(fit.values))
    share = F.array(*[F.lit(float(v / fit.trace)) for v in fit.values])
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    return out.select("vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"))
