"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from newsloom.settings import work_folder, written

__all__ = ["arrow_texts", "broadcast_if_small", "parts_of", "read_table", "spans", "work_folder", "written"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_texts(column: pa.Array) -> Iterator[str]:
    """Texts of a string column one by one; null reads as empty."""
    for value in column:
        text = value.as_py()
        yield "" if text is None else text


def spans(column: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string column, each of at most so many bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield start, stop
        start = stop


def trim() -> None:
    """Gives memory that is free inside this process back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def parts_of(batches: Iterable[pa.RecordBatch], text: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose texts (column number `text`) are each of at most so many bytes, or one row.

    At the end of its task a worker lets go of what is free: it waits for later tasks, beside stages that need no Python.
    """
    batch = None
    for batch in batches:
        for start, stop in spans(batch.column(text), most_bytes):
            yield batch.slice(start, stop - start)
    del batch
    trim()


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, most_bytes: int = 32 << 20) -> DataFrame:
    """Marks a side for broadcast only where its counted rows are known to fit; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= most_bytes else df


def finite_vector(vector: Column) -> Column:
    """True for a non-empty vector without null, NaN or infinite components."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(ok & (F.size(vector) > 0), F.lit(False))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def with_base(parts: DataFrame, number: str, amount: str, group: int = 1024) -> DataFrame:
    """`base`: the sum of `amount` over all rows of a smaller `number` (a distinct long).

    Sums run inside groups of consecutive numbers, then over the groups' totals, so the one task
    without a key sees a row per group only.
    """
    grouped = parts.withColumn("_group", F.floor(F.col(number) / group))
    totals = grouped.groupBy("_group").agg(F.sum(amount).alias("_total"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.withColumn("_earlier", F.coalesce(F.sum("_total").over(before.orderBy("_group")), F.lit(0))).drop("_total")
    inside = F.coalesce(F.sum(amount).over(before.partitionBy("_group").orderBy(number)), F.lit(0))
    return grouped.withColumn("_inside", inside).join(earlier, "_group").withColumn("base", F.col("_inside") + F.col("_earlier")).drop("_group", "_inside", "_earlier")
