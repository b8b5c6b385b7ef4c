"""Views of the given tables in the shapes of the news flow.

`events` stand for scored articles, `documents` for clean articles and feed documents, `pages`
for the crawl, `nation` for a ticker list and `embeddings` for model logits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.functions.hints import extract_hints
from newsloom.functions.strings import string_array
from newsloom.functions.urls import normalize_url
from newsloom.operators.dedup import first_per_key
from newsloom.sources.tickers import tickers_from_frame, tickers_from_rows

# The ticker dictionary as plain CSV rules read it.
TICKER_ROWS = [
    ("AAPL", "Apple Inc", "Apple;Apple Computer;Apple Incorporated"),
    ("MSFT", "Microsoft Corporation", "Microsoft;MS;MS Corp"),
    ("NVDA", "NVIDIA Corporation", "NVIDIA;NVidia"),
    ("GOOGL", "Alphabet Inc. Class A", "Alphabet;Google;Google Inc;Google LLC"),
    ("GOOG", "Alphabet Inc. Class C", "Alphabet;Google;Google Inc;Google LLC"),
    ("AMZN", "Amazon.com", "Inc."),
    ("META", "Meta Platforms", "Inc."),
]

# Titles given to the documents, which hold no news words of their own.
DOC_TITLES = [
    "$AAPL reports earnings",
    "($MSFT) outlook",
    "Apple Inc unveils chip",
    "Google merger",
    "$TOOLONG lawsuit",
    "$NVDA $MSFT upgrade",
    "inflation",
    "",
]
DOC_HOSTS = ["ir.example.com", "www.msft.com", "news.example.org"]

AS_OF_MS = 1_706_745_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics_of(event_type: Column) -> Column:
    return (
        F.when(event_type == "purchase", string_array(["earnings", "product"]))
        .when(event_type == "signup", string_array(["guidance"]))
        .when(event_type == "click", string_array(["macro", "product"]))
        .when(event_type == "view", string_array(["legal"]))
        .otherwise(string_array([]))
    )


def scored_of(events: DataFrame) -> DataFrame:
    """Scored articles; `ts` keeps the type it has in the table."""
    return events.select(
        "ts",
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("https://example.com/n/"), "event_id").alias("url"),
        F.concat_ws(" ", "event_type", "event_id").alias("title"),
        F.array_distinct(
            F.array(F.concat(F.lit("T"), F.col("user_id") % 20), F.concat(F.lit("T"), F.col("event_id") % 7))
        ).alias("tickers"),
        ((F.col("event_id") % 201 - 100) / 100.0).cast("float").alias("sentiment"),
        topics_of(F.col("event_type")).alias("topics"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_of(table(spark, sf_dir, "events"))


def scored_messages(events: DataFrame) -> DataFrame:
    """The same articles as they are published: time in epoch milliseconds."""
    return scored_of(events).withColumn("scored_ts", F.unix_millis(F.col("ts").cast("timestamp"))).drop("ts")


def as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The newest event time, as a literal, so that time filters reach the scan."""
    newest = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return F.expr(f"TIMESTAMP_NTZ '{newest}'") if newest else F.expr("TIMESTAMP_NTZ '1970-01-01'")


HASHED_LABELS = ("neutral", "positive", "negative")


def hashed_weights(buckets: int = 1024) -> np.ndarray:
    """Weights of a linear model by a rule, in steps of a 64th, a column per label."""
    number, column = np.arange(buckets)[:, None], np.arange(1, 4)[None, :]
    return (number * column * 40_503 % 129 - 64) / 64


def whole_window(spark: SparkSession, sf_dir: str) -> int:
    """Minutes of a trailing window that holds all events."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = table(spark, sf_dir, "events").agg(F.min(at).alias("first"), F.max(at).alias("last")).first()
    return 1 + (ends["last"] - ends["first"]) // 60_000_000 if ends["first"] is not None else 0


def tickers(spark: SparkSession) -> DataFrame:
    return tickers_from_rows(spark, TICKER_ROWS)


def tickers_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary that grows with the tables: a symbol of frequent letters per customer, and per
    document one whose name is the first twelve characters of its text."""

    def letters(number: Column) -> Column:
        return F.translate(F.hex(number.cast("bigint")), "0123456789ABCDEF", "ETAOINSHRDLUCMFW")

    customers = table(spark, sf_dir, "customer").select(
        letters(F.col("c_custkey")).alias("symbol"), F.col("c_name").alias("name"), F.lit("").alias("aliases"), F.col("c_custkey").cast("int").alias("ord")
    )
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Z"), letters(F.col("doc_id"))).alias("symbol"), F.substring("text", 1, 12).alias("name"), F.lit("").alias("aliases"),
        (F.lit(1_000_000_000) + F.col("doc_id")).cast("int").alias("ord"),
    )
    return tickers_from_frame(customers.unionByName(docs))


def _pick(values: list[str], number: Column) -> Column:
    return F.get(string_array(values), (number % len(values)).cast("int"))


def documents_as_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clean articles: a news title, the whole text with the title repeated at its
    end as body, and hints from a URL on one of three hosts."""
    title = _pick(DOC_TITLES, F.col("doc_id"))
    url = F.concat(
        F.lit("https://"), _pick(DOC_HOSTS, F.col("doc_id")), F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"),
        F.lit("-story_"), F.col("doc_id"),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        "source",
        url.alias("url"),
        title.alias("title"),
        F.concat("text", F.lit(" "), title).alias("body"),
        F.lit(0).cast("bigint").alias("published_ts"),
    )


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_clean(spark, sf_dir).withColumn("hints", extract_hints(F.col("url"), F.col("body")))


def pages_as_items(pages: DataFrame) -> DataFrame:
    """Pages as feed items; every third has no usable publication time."""
    published = F.when(F.col("page_id") % 3 == 0, F.lit(0)).otherwise(F.lit(1_700_000_000_000) + F.col("page_id"))
    return pages.select(
        F.lit("crawl").alias("source"),
        F.concat(F.lit("page "), F.col("page_id")).alias("title"),
        F.col("url").alias("link"),
        published.cast("bigint").alias("published_ts"),
    )


def pages_as_crawl(pages: DataFrame) -> DataFrame:
    """Pages as fetch results by normalized URL; of pages sharing one, the first is kept."""
    fetched = pages.select(normalize_url(F.col("url")).alias("url"), "page_id", "html")
    first = first_per_key(fetched, ["url"], ["page_id"])
    return first.select("url", F.lit(200).alias("status"), "html")


def _escaped(text: Column) -> Column:
    amp = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(amp, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _xml(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def documents_as_feeds(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """One feed per document, polled at its own hour, with its whole text as the first item's title
    and a link made of the text, so copies of a text within a source are one article. The second
    item is named after the source and has no link in every fifth feed. `kind` is `rss`, `atom` or
    `mixed`: by language RSS, Atom, RDF or text that is no feed at all."""
    doc = F.col("doc_id")
    text, source = _escaped(F.col("text")), F.col("source")
    has_link = doc % 5 != 0
    link = _xml("https://example.com/d/", F.md5("text"))

    rss_two = F.when(has_link, _xml("<link>", link, "/b</link>")).otherwise("")
    rss_items = _xml(
        "<item><title>", text, "</title><link>", link, "</link></item><item><title>", source, "</title>", rss_two, "</item>"
    )
    rss = _xml("<?xml version='1.0'?><rss><channel><title>c</title>", rss_items, "</channel></rss>")
    rdf = _xml("<rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'>", rss_items, "</rdf:RDF>")
    atom_two = F.when(has_link, _xml("<link href='", link, "/b'/>")).otherwise("")
    atom = _xml(
        "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>", text, "</title><link rel='self'/><link href='", link,
        "'/></entry><entry><title>", source, "</title>", atom_two, "</entry></feed>",
    )
    lang = F.col("lang")
    mixed = F.when(lang == "en", rss).when(lang == "fr", atom).when(lang == "de", rdf).otherwise(F.col("text"))
    xml = {"rss": rss, "atom": atom, "mixed": mixed}[kind]
    polled = F.lit(AS_OF_MS) + doc * 3_600_000
    return table(spark, sf_dir, "documents").select("source", xml.alias("xml"), polled.alias("fetched_ts"))
