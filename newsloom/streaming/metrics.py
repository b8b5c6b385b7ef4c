"""Trailing metrics as streaming aggregates.

Sliding windows are made of panes one slide long: a row updates the one pane it falls in, and a pane,
once the watermark has closed it, adds its sums to the windows it belongs to. With a window of an hour
that slides by a minute a row costs one update and not sixty. Windows come out once, in append mode,
when the watermark passes their end; rows later than the watermark do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def live_minute_counts(df: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Articles per minute: `minute, n`."""
    return (
        df.select(F.col("ts").cast("timestamp").alias("ts"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 minute").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("minute"), "n")
    )


def _windows_of_panes(rows: DataFrame, key: str, sums: dict[str, Column], minutes: int, slide: str, lateness: str) -> DataFrame:
    """`window_end, <key>` and the named sums over sliding windows of rows with `ts`; `slide` divides `minutes`."""
    panes = rows.withWatermark("ts", lateness).groupBy(F.window("ts", slide).alias("pane"), key)
    panes = panes.agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    windows = panes.groupBy(F.window(F.window_time("pane"), f"{int(minutes)} minutes", slide).alias("w"), key)
    return windows.agg(*[F.sum(name).alias(name) for name in sums]).select(F.col("w.end").alias("window_end"), key, *sums)


def live_ticker_sentiment(
    df: DataFrame, minutes: int = 60, slide: str = "1 minute", min_count: int = 3, lateness: str = "10 minutes"
) -> DataFrame:
    """Mean sentiment and count per ticker over sliding windows: `window_end, ticker, avg_sent, n`."""
    rows = df.select(F.col("ts").cast("timestamp").alias("ts"), F.explode("tickers").alias("ticker"), F.col("sentiment").cast("double").alias("sentiment"))
    sums = {"total": F.col("sentiment"), "known": F.when(F.col("sentiment").isNotNull(), 1).otherwise(0), "n": F.lit(1)}
    windows = _windows_of_panes(rows, "ticker", sums, minutes, slide, lateness).filter(F.col("n") >= min_count)
    return windows.select("window_end", "ticker", F.try_divide("total", "known").alias("avg_sent"), "n")


def live_label_counts(df: DataFrame, label: str, minutes: int = 60, slide: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Articles per `source`, or per entry of an array column such as `topics`, over sliding windows: `window_end, label, n`."""
    is_array = df.schema[label].dataType.typeName() == "array"
    value = F.explode(label) if is_array else F.col(label)
    rows = df.select(F.col("ts").cast("timestamp").alias("ts"), value.alias("label"))
    return _windows_of_panes(rows, "label", {"n": F.lit(1)}, minutes, slide, lateness)
