"""Queries over the scored table."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import analytics

NOW = datetime(2024, 1, 10, 12, 0, 0)


def rows(spark, specs):
    data = [(NOW - timedelta(minutes=m), str(i), s, "u", "t", t, v, []) for i, (m, s, t, v) in enumerate(specs)]
    return spark.createDataFrame(
        data, "ts timestamp, id string, source string, url string, title string, tickers array<string>, sentiment float, topics array<string>"
    )


def test_parameters():
    assert analytics.clamp("900", analytics.LATEST_CAP) == 500 and analytics.clamp(3, 100) == 3
    with pytest.raises(ValueError):
        analytics.clamp(-1, 10)


def test_window_and_having(spark):
    df = rows(spark, [(0, "a", ["X", "Y"], 0.5), (60, "a", ["X"], 0.1), (61, "a", ["X"], -1.0), (5, "b", [], 0.0)])
    out = {r["ticker"]: (round(r["avg_sent"], 6), r["n"]) for r in analytics.ticker_sentiment(df, 60, 1, F.lit(NOW)).collect()}
    assert out == {"X": (0.3, 2), "Y": (0.5, 1)}
    assert [r["ticker"] for r in analytics.ticker_sentiment(df, 60, 2, NOW).collect()] == ["X"]


def test_window_is_capped_for_the_served_query(spark):
    df = rows(spark, [(1439, "a", ["X"], 0.5), (1441, "a", ["Y"], 0.5)])
    assert [r["ticker"] for r in analytics.top_sentiment(df, 10_000, 0, NOW).positives.collect()] == ["X"]


def test_feed_keeps_the_newest(spark):
    df = rows(spark, [(m, "s", ["X"], 0.0) for m in range(51)] + [(7 * 24 * 60, "s", ["OLD"], 0.0), (7 * 24 * 60 - 1, "s", ["EDGE"], 0.0)])
    feed = analytics.ticker_feed(df, 50, 604_800, NOW)
    assert feed.filter("ticker = 'X'").count() == 50
    assert feed.filter("ticker = 'X' and id = '50'").count() == 0
    assert {r["ticker"] for r in feed.select("ticker").distinct().collect()} == {"X", "EDGE"}
    assert "OLD" in {r["ticker"] for r in analytics.ticker_feed(df, 50, 0, NOW).collect()}
    assert [r["id"] for r in analytics.ticker_feed_query(feed, "x", 2).collect()] == ["0", "1"]


def test_feed_is_trimmed_before_the_exchange(spark, plan):
    df = rows(spark, [(m, "s", ["X"], 0.0) for m in range(5)])
    text = plan(analytics.ticker_feed(df, 3, 604_800, NOW))
    assert "WindowGroupLimit" in text and text.count("Exchange hashpartitioning") <= 1


def test_merge_prefers_the_stored_copy(spark):
    stored = rows(spark, [(0, "stored", [], 0.0), (1, "stored", [], 0.0)])
    live = rows(spark, [(0, "live", [], 0.0), (1, "live", [], 0.0), (2, "live", [], 0.0)])
    live = live.withColumn("scored_ts", F.unix_millis("ts")).drop("ts")
    assert [(r["id"], r["source"]) for r in analytics.merge_live(live, stored).collect()] == [("0", "stored"), ("1", "stored"), ("2", "live")]


def test_sorted_limits_do_not_sort_everything(spark, plan):
    df = rows(spark, [(0, "a", ["X"], 0.5)])
    assert "TakeOrderedAndProject" in plan(analytics.latest(df, 10))
    assert "TakeOrderedAndProject" in plan(analytics.movers(analytics.ticker_sentiment(df, 60, 1, NOW)).positives)


def test_both_ends_share_one_aggregate(spark, plan):
    df = rows(spark, [(0, "a", ["X"], 0.5), (0, "a", ["Y"], -0.5)])
    ends = analytics.top_sentiment_ends(df, 60, 1, NOW)
    assert [(r["side"], r["ticker"]) for r in ends.collect()] == [("positive", "X"), ("positive", "Y"), ("negative", "Y"), ("negative", "X")]
    assert "ReusedExchange" in ends._jdf.queryExecution().executedPlan().toString()
