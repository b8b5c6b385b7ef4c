"""Recent items per ticker, kept by a stream.

Each micro-batch is trimmed to the last `n` rows of each ticker inside every task, before anything is
exchanged, and merged with the stored lists; so a ticker with most of the rows sends `n` rows per
task, and what is stored is bounded by tickers times `n`. The lists are a table of versions, one per
micro-batch: a repeated batch starts from the version before it and gives the same lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.settings import SinkOptions
from newsloom.sinks.commits import Folder

FEED_SCHEMA = "ticker string, rank int, scored_ts bigint, payload string, pushed_ms bigint"


def _versions(folder: Folder) -> list[int]:
    """Numbers of the complete versions, ascending."""
    named = [n for n in folder.names() if n.startswith("version=")]
    return sorted(int(n.split("=")[1]) for n in named if folder.exists(f"{n}/_SUCCESS"))


def _last_n(rows: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("ticker").orderBy(F.desc("scored_ts"), F.desc("payload"))
    return rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def push_batch(rows: DataFrame, folder: str, batch: int, options: SinkOptions = SinkOptions(), now_ms: Column | None = None) -> None:
    """Merges a batch of `tickers, scored_ts, payload` into the lists and stores them as version `batch`.

    A push renews all of a ticker's list for `feed_ttl_s` seconds (0: for ever); expired lists go.
    Rows without tickers or arrival time push nothing. Two versions are kept, for readers.
    """
    spark, files = rows.sparkSession, Folder(rows.sparkSession, folder)
    now = F.lit(now_ms if now_ms is not None else F.unix_millis(F.current_timestamp()))
    pushed = rows.where(F.col("scored_ts").isNotNull()).select(F.explode("tickers").alias("ticker"), "scored_ts", "payload").where(F.col("ticker").isNotNull())
    merged = _last_n(pushed, options.feed_rows).drop("rank").withColumn("pushed_ms", now)
    before = [v for v in _versions(files) if v < batch]
    if before:
        stored = spark.read.schema(FEED_SCHEMA).parquet(f"{folder}/version={before[-1]}").drop("rank")
        merged = merged.unionByName(stored)
    last_push = F.max("pushed_ms").over(Window.partitionBy("ticker"))
    if options.feed_ttl_s > 0:
        # What was pushed a TTL before this batch is gone, unless the batch pushes to it again: then its list starts anew.
        merged = merged.where(now - F.col("pushed_ms") < options.feed_ttl_s * 1000)
    lists = _last_n(merged, options.feed_rows).withColumn("pushed_ms", last_push)
    lists.select("ticker", F.col("rank").cast("int").alias("rank"), "scored_ts", "payload", "pushed_ms").write.mode("overwrite").parquet(f"{folder}/version={batch}")
    for old in before[:-1]:
        files.delete(f"version={old}")


def read_feed(spark: SparkSession, folder: str, options: SinkOptions = SinkOptions(), now_ms: Column | None = None) -> DataFrame:
    """`ticker, rank, scored_ts, payload` of the lists that have not expired."""
    versions = _versions(Folder(spark, folder))
    if not versions:
        return spark.createDataFrame([], FEED_SCHEMA).drop("pushed_ms")
    lists = spark.read.schema(FEED_SCHEMA).parquet(f"{folder}/version={versions[-1]}")
    if options.feed_ttl_s > 0:
        now = F.lit(now_ms if now_ms is not None else F.unix_millis(F.current_timestamp()))
        lists = lists.where(now - F.col("pushed_ms") < options.feed_ttl_s * 1000)
    return lists.drop("pushed_ms")


def start_ticker_feed(scored: DataFrame, folder: str, checkpoint: str, options: SinkOptions = SinkOptions(), trigger: dict | None = None) -> StreamingQuery:
    """Rows with `tickers`, arrival time `scored_ts` in epoch ms and a `payload` into the feeds."""
    stream = scored.writeStream.foreachBatch(lambda rows, batch: push_batch(rows, folder, batch, options))
    return stream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()
