"""Feed documents to items. Parsing is `from_xml`, so a document never leaves the JVM."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.times import as_of_ms

# Repeated children are arrays, so "the first one" is ours to pick. Tag case is ignored.
_FEED_XML = """
    channel ARRAY<STRUCT<item ARRAY<STRUCT<title ARRAY<STRING>, link ARRAY<STRING>, pubDate ARRAY<STRING>>>>>,
    item ARRAY<STRUCT<title ARRAY<STRING>, link ARRAY<STRING>, pubDate ARRAY<STRING>>>,
    entry ARRAY<STRUCT<title ARRAY<STRING>, link ARRAY<STRUCT<_href STRING, _VALUE STRING>>, published ARRAY<STRING>>>
"""
_ITEMS = "array<struct<title:string,link:string,published:string>>"
# Comments and instructions, an unclosed one up to the end, so that each character is read once.
_ASIDES = r"(?s)<!--.*?(?:-->|\z)|<\?.*?(?:\?>|\z)"
_ROOT = r"(?s)\A\s*+(?:<!DOCTYPE[^\[>]*+(?:\[[^\]]*+\])?[^>]*+>\s*+)?<([A-Za-z][A-Za-z0-9:]*+)"

# Date formats of RSS (after the weekday) and Atom.
_DATE_FORMATS = ["d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss xx", "yyyy-MM-dd'T'HH:mm:ssXXX"]


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _item(i: Column) -> Column:
    return F.struct(
        _first(i["title"]).alias("title"), _first(i["link"]).alias("link"), _first(i["pubDate"]).alias("published")
    )


def _entry(e: Column) -> Column:
    href = F.filter(e["link"], lambda l: l["_href"].isNotNull())
    return F.struct(
        _first(e["title"]).alias("title"),
        _first(href)["_href"].alias("link"),
        _first(e["published"]).alias("published"),
    )


def _or_none(items: Column) -> Column:
    return F.coalesce(items.cast(_ITEMS), F.array().cast(_ITEMS))


def _explode_items(feeds: DataFrame, items: Column, published: str, as_of) -> DataFrame:
    if published not in ("ingest", "parse"):
        raise ValueError("published must be 'ingest' or 'parse'")
    rows = feeds.select("source", F.explode(items).alias("item")).select("source", "item.*")
    rows = rows.filter((F.col("title") != "") & (F.col("link") != ""))
    ingest = as_of_ms(as_of)
    if published == "ingest":
        when = ingest
    else:
        text = F.regexp_replace(F.trim("published"), r"\A[A-Za-z]+,\s*", "")
        tries = [F.unix_millis(F.try_to_timestamp(text, F.lit(f))) for f in _DATE_FORMATS]
        when = F.coalesce(*tries, ingest)
    return rows.select("source", "title", "link", when.alias("published_ts"))


def _parsed(feeds: DataFrame, xml: str) -> DataFrame:
    text = F.regexp_replace(F.col(xml), F.lit("\\A\\x{FEFF}"), F.lit(""))  # a byte order mark
    return feeds.select(
        "source",
        F.lower(F.regexp_extract(F.regexp_replace(text, F.lit(_ASIDES), F.lit("")), _ROOT, 1)).alias("root"),
        F.from_xml(text, _FEED_XML, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}).alias("doc"),
    )


def _rss(doc: str = "doc") -> Column:
    in_channels = F.flatten(F.transform(F.col(f"{doc}.channel"), lambda c: F.coalesce(F.transform(c["item"], _item), F.array().cast(_ITEMS))))
    return F.concat(_or_none(in_channels), _or_none(F.transform(F.col(f"{doc}.item"), _item)))


def _atom(doc: str = "doc") -> Column:
    return _or_none(F.transform(F.col(f"{doc}.entry"), _entry))


def rss_items(feeds: DataFrame, xml: str = "xml", published: str = "ingest", as_of: int | datetime | None = None) -> DataFrame:
    """Items of RSS and RDF documents: `source, title, link, published_ts`."""
    rss = _parsed(feeds, xml).filter(F.col("root").isin("rss", "rdf:rdf"))
    return _explode_items(rss, _rss(), published, as_of)


def atom_items(feeds: DataFrame, xml: str = "xml", published: str = "ingest", as_of: int | datetime | None = None) -> DataFrame:
    """Entries of Atom documents; the link is the first one with an `href`."""
    atom = _parsed(feeds, xml).filter(F.col("root") == "feed")
    return _explode_items(atom, _atom(), published, as_of)


def feed_items(feeds: DataFrame, xml: str = "xml", published: str = "ingest", as_of: int | datetime | None = None) -> DataFrame:
    """Items of any feed, chosen by root element; text that is not XML gives no rows.

    Each document is parsed once, whichever kind it is.
    """
    items = (
        F.when(F.col("root").isin("rss", "rdf:rdf"), _rss())
        .when(F.col("root") == "feed", _atom())
        .otherwise(F.array().cast(_ITEMS))
    )
    return _explode_items(_parsed(feeds, xml), items, published, as_of)


def expand_feeds(feeds: DataFrame, tickers: DataFrame, template: str, prefix: str, symbol: str = "symbol") -> DataFrame:
    """The configured feeds plus one per ticker, with `{TICKER}` in the URL template replaced."""
    generated = tickers.select(
        F.concat(F.lit(prefix), F.col(symbol)).alias("source"),
        F.replace(F.lit(template), F.lit("{TICKER}"), F.col(symbol)).alias("url"),
    )
    return feeds.select("source", "url").unionByName(generated)
