"""Parquet sinks of scored articles.

Before a partitioned write the rows are rebalanced by partition. Rebalancing is adaptive: small
partitions share a task, and a day or hour with most of the rows is split over many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions.times import hour_bucket
from newsloom.schemas import NEWS_SCORED_SCHEMA, SCORED_SCHEMA

HOUR_COLUMNS = ["year", "month", "day", "hour"]


def with_hour(df: DataFrame) -> DataFrame:
    """Archive rows with the UTC hour of `scored_ts` as zero-padded partition columns."""
    hour = hour_bucket(F.col("scored_ts"))
    parts = {name: F.date_format(hour, fmt) for name, fmt in zip(HOUR_COLUMNS, ("yyyy", "MM", "dd", "HH"))}
    return df.select(*SCORED_SCHEMA.names).withColumns(parts)


def write_hourly_archive(df: DataFrame, root: str, max_rows: int = 500, mode: str = "append") -> None:
    """Archive scored rows under `year=/month=/day=/hour=`, zstd, at most `max_rows` per file.

    The default keeps files as small as a live feed makes them; raise it for bulk loads.
    """
    rows = with_hour(df).hint("rebalance", *[F.col(c) for c in HOUR_COLUMNS])
    (
        rows.write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_rows)
        .partitionBy(*HOUR_COLUMNS)
        .parquet(root)
    )


def to_news_scored(df: DataFrame) -> DataFrame:
    """Rows in the shape of the analytics table. A missing `ts` is the time of `scored_ts`, or now;
    `date` is the day of `ts`."""
    if "ts" in df.columns:
        ts = F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp())
    elif "scored_ts" in df.columns:
        ts = F.coalesce(F.timestamp_millis("scored_ts"), F.current_timestamp())
    else:
        ts = F.current_timestamp()
    # Milliseconds are the precision of the table.
    rows = df.withColumn("ts", F.date_trunc("millisecond", ts)).withColumn("date", F.to_date("ts"))
    return rows.select(*[F.col(n).cast(NEWS_SCORED_SCHEMA[n].dataType).alias(n) for n in NEWS_SCORED_SCHEMA.names])


def write_news_scored(df: DataFrame, path: str, mode: str = "append", sort: tuple[str, ...] = ("ts",)) -> None:
    """Append to the table, partitioned by date and sorted by time inside each file, so a trailing
    window prunes partitions by date and row groups by time. `sort=("tickers", "ts")` gives key
    order instead."""
    rows = to_news_scored(df).hint("rebalance", F.col("date")).sortWithinPartitions("date", *sort)
    rows.write.mode(mode).option("compression", "zstd").partitionBy("date").parquet(path)
