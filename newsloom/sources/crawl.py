"""Crawl tables: fetched pages by URL, and the gates in front of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.functions.strings import ascii_lower
from newsloom.functions.urls import url_host


def successful_fetches(crawl: DataFrame) -> DataFrame:
    """Rows whose fetch answered with a 2xx status."""
    return crawl.filter(F.col("status").between(200, 299))


def robots_filter(pages: DataFrame, robots: DataFrame, rule: str = "disallow: /quote/", url: str = "url") -> DataFrame:
    """Drop pages of hosts whose robots text holds the rule; hosts without a readable text pass.

    Only the blocked hosts take part in the join, and only their names, so the right side is as
    small as the rule allows and Spark can broadcast it when its size says so.
    """
    blocked = (
        robots.filter((F.col("status") == 200) & F.contains(ascii_lower(F.col("body")), F.lit(rule)))
        .select(F.col("host").alias("_blocked_host"))
        .distinct()
    )
    return pages.join(blocked, url_host(F.col(url)) == F.col("_blocked_host"), "left_anti")


def attach_html(raw: DataFrame, crawl: DataFrame) -> DataFrame:
    """Raw articles with the HTML fetched for their URL; articles without a 2xx page drop out.

    `crawl` holds one row per URL. Status and nulls are filtered before the exchange, and only
    `url` and `html` are carried through it.
    """
    html = successful_fetches(crawl).filter(F.col("html").isNotNull()).select("url", "html")
    return raw.join(html, "url")
