"""Questions over the scored table: recent rows, counts, movers and per-ticker feeds.

Every query takes `as_of`; without it the wall clock is used. Ties are broken by a second key,
so results are deterministic.
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.functions.times import as_of_ts, minute_floor

# Caps and defaults of the query parameters, and the lengths of the lists.
LATEST_CAP, WINDOW_CAP, MIN_COUNT_CAP, FEED_CAP = 500, 1440, 100, 200
MOVERS, TOP_SOURCES, TOP_TOPICS = 20, 10, 15
LIVE_ROWS, STORED_ROWS = 200, 100
DISPLAY_MOVERS, DISPLAY_STATS = 10, 8


def clamp(value: int, cap: int) -> int:
    """A parameter limited from above; a negative one is an error."""
    value = int(value)
    if value < 0:
        raise ValueError(f"negative parameter: {value}")
    return min(value, cap)


def recent(df: DataFrame, minutes: int, as_of: datetime | Column | None = None) -> DataFrame:
    """Rows at or after `as_of - minutes`. On a table with a `date` partition column the bound is
    stated for it as well, so whole partitions are skipped."""
    start = as_of_ts(as_of) - F.expr(f"interval {int(minutes)} minutes")
    rows = df.filter(F.col("ts") >= start)
    return rows.filter(F.col("date") >= F.to_date(start)) if "date" in df.columns else rows


def latest(df: DataFrame, limit: int = 50) -> DataFrame:
    return (
        df.select("ts", "id", "source", "url", "title", "tickers", "sentiment", "topics")
        .orderBy(F.desc("ts"), "id")
        .limit(clamp(limit, LATEST_CAP))
    )


def ops_latest(df: DataFrame, limit: int = 50) -> DataFrame:
    return df.select("ts", "id", "title", "tickers", "sentiment", "topics").orderBy(F.desc("ts"), "id").limit(limit)


def ticker_sentiment(df: DataFrame, minutes: int = 60, min_count: int = 3, as_of: datetime | Column | None = None) -> DataFrame:
    """Mean sentiment and article count per ticker in a trailing window."""
    return (
        recent(df, minutes, as_of)
        .select(F.explode("tickers").alias("ticker"), F.col("sentiment").cast("double").alias("sentiment"))
        .groupBy("ticker")
        .agg(F.avg("sentiment").alias("avg_sent"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )


class Movers(NamedTuple):
    positives: DataFrame
    negatives: DataFrame


def movers(means: DataFrame, n: int = MOVERS) -> Movers:
    """Both ends of a per-ticker mean table."""
    return Movers(
        means.orderBy(F.desc("avg_sent"), "ticker").limit(n),
        means.orderBy(F.asc("avg_sent"), "ticker").limit(n),
    )


def top_sentiment(df: DataFrame, minutes: int = 60, min_count: int = 3, as_of: datetime | Column | None = None) -> Movers:
    """Both ends over a window and count limited as the served query limits them."""
    return movers(ticker_sentiment(df, clamp(minutes, WINDOW_CAP), clamp(min_count, MIN_COUNT_CAP), as_of))


def top_sentiment_ends(df: DataFrame, minutes: int = 60, min_count: int = 3, as_of: datetime | Column | None = None) -> DataFrame:
    """Both ends as one result with a `side` column; the scan and the aggregate's exchange are
    shared between them."""
    ends = top_sentiment(df, minutes, min_count, as_of)
    return ends.positives.withColumn("side", F.lit("positive")).unionByName(
        ends.negatives.withColumn("side", F.lit("negative"))
    )


def minute_series(df: DataFrame, minutes: int = 60, as_of: datetime | Column | None = None) -> DataFrame:
    """Articles per minute, oldest first; minutes without articles are absent."""
    return (
        recent(df, minutes, as_of)
        .groupBy(minute_floor(F.col("ts")).alias("minute"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("minute")
    )


def _top_counts(rows: DataFrame, label: str, limit: int) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(limit)


def source_counts(df: DataFrame, minutes: int = 60, as_of: datetime | Column | None = None, limit: int = TOP_SOURCES) -> DataFrame:
    return _top_counts(recent(df, minutes, as_of), "source", limit)


def topic_counts(df: DataFrame, minutes: int = 60, as_of: datetime | Column | None = None, limit: int = TOP_TOPICS) -> DataFrame:
    return _top_counts(recent(df, minutes, as_of).select(F.explode("topics").alias("topic")), "topic", limit)


class Stats(NamedTuple):
    series: DataFrame
    sources: DataFrame
    topics: DataFrame


def stats(df: DataFrame, minutes: int = 60, as_of: datetime | Column | None = None) -> Stats:
    return Stats(
        minute_series(df, minutes, as_of), source_counts(df, minutes, as_of), topic_counts(df, minutes, as_of)
    )


def ticker_feed(
    df: DataFrame,
    n: int = 50,
    ttl_s: int = 604_800,
    as_of: datetime | Column | None = None,
    arrival: str = "ts",
    tie: str = "id",
) -> DataFrame:
    """The newest `n` rows of each ticker with their `rank`, for tickers whose newest row is
    younger than `ttl_s` (0: no expiry).

    The rank filter sits right on the window, so Spark trims every ticker to `n` rows per task
    before the exchange and a ticker with a third of all rows costs no more than the others.
    """
    by_ticker = Window.partitionBy("ticker")
    ranked = (
        df.filter(F.col("tickers").isNotNull())
        .select(F.explode("tickers").alias("ticker"), *df.columns)
        .withColumn("rank", F.row_number().over(by_ticker.orderBy(F.desc(arrival), F.desc(tie))))
        .filter(F.col("rank") <= n)
    )
    if ttl_s <= 0:
        return ranked
    limit = as_of_ts(as_of) - F.expr(f"interval {int(ttl_s)} seconds")
    newest = F.max(arrival).over(by_ticker)
    return ranked.withColumn("_newest", newest).filter(F.col("_newest") > limit).drop("_newest")


def ticker_feed_query(feed: DataFrame, symbol: str, limit: int = 50) -> DataFrame:
    """The first rows of one ticker's feed; the symbol may be given in any case."""
    return feed.filter((F.col("ticker") == symbol.upper()) & (F.col("rank") <= clamp(limit, FEED_CAP))).orderBy("rank")


def merge_live(live: DataFrame, stored: DataFrame, limit: int = LIVE_ROWS, live_rows: int = LIVE_ROWS, stored_rows: int = STORED_ROWS) -> DataFrame:
    """Live and stored rows as one list without repeated ids, newest first.

    Both sides are short lists to begin with: the newest `live_rows` and `stored_rows` of them.
    A stored copy replaces the live one. Rows order by `scored_ts`, or by `ts` where it is missing.
    """
    columns = ["id", "source", "url", "title", "tickers", "sentiment", "topics", "time_ms"]

    def shaped(df: DataFrame, n: int, priority: int) -> DataFrame:
        ms = F.unix_millis(F.col("ts").cast("timestamp")) if "ts" in df.columns else F.lit(None).cast("bigint")
        if "scored_ts" in df.columns:
            ms = F.coalesce("scored_ts", ms)
        rows = df.withColumn("time_ms", ms).select(*columns)
        return rows.orderBy(F.desc("time_ms"), "id").limit(n).withColumn("_priority", F.lit(priority))

    both = shaped(live, live_rows, 1).unionByName(shaped(stored, stored_rows, 0))
    one_each = Window.partitionBy("id").orderBy("_priority", F.desc("time_ms"))
    return (
        both.withColumn("_copy", F.row_number().over(one_each))
        .filter("_copy = 1")
        .orderBy(F.desc("time_ms"), "id")
        .limit(limit)
        .select(*columns)
    )
