"""Feed to scored article, stage by stage.

Every stage takes and returns a DataFrame and works on static and streaming input alike, except
where a docstring says otherwise. Apart from the page join and the first-seen filter, all of them
are row-local, so Spark runs consecutive stages without an exchange between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.functions.hints import extract_hints
from newsloom.functions.ids import stable_id
from newsloom.functions.language import detect_language, filter_english, filter_min_body
from newsloom.functions.strings import TITLE_BREAK
from newsloom.functions.times import as_of_ms
from newsloom.functions.topics import topic_rules
from newsloom.functions.urls import normalize_url
from newsloom.operators.dedup import dedup_ttl
from newsloom.operators.html import extract_links, parse_html
from newsloom.operators.scoring import Scorer, score
from newsloom.operators.tickers import EntityExtractor, with_tickers
from newsloom.settings import CleanOptions, IngestOptions, ResolveOptions, ScoreOptions, written
from newsloom.sources.crawl import attach_html, robots_filter, successful_fetches
from newsloom.sources.feeds import feed_items


def to_raw(items: DataFrame, as_of=None, algo: str = "xxh64", link: str = "link") -> DataFrame:
    """Raw articles of `source, title, link, published_ts` items. A missing or non-positive
    publication time becomes the ingest time."""
    now = as_of_ms(as_of)
    published = F.when(F.col("published_ts") > 0, F.col("published_ts")).otherwise(now)
    return items.withColumn("url", normalize_url(F.col(link))).select(
        stable_id(F.col("source"), F.col("url"), algo).alias("id"),
        "source",
        "url",
        "title",
        F.lit("").alias("body"),
        published.alias("published_ts"),
        now.alias("ingested_ts"),
    )


def ingest_batch(
    feeds: DataFrame, as_of=None, published: str = "ingest", options: IngestOptions = IngestOptions(), algo: str = "xxh64"
) -> DataFrame:
    """New raw articles of a batch of feed documents (`source, xml`, and `fetched_ts` in epoch ms
    when the batch spans several polls). Static input only."""
    if "fetched_ts" not in feeds.columns:
        raw = to_raw(feed_items(feeds, published=published, as_of=as_of), as_of, algo)
    else:
        # The poll time rides along in the source column of the item rows.
        tagged = feeds.withColumn("source", F.struct("source", "fetched_ts"))
        items = feed_items(tagged, published=published, as_of=0)
        polled = items.select(
            F.col("source.source").alias("source"), "title", "link", "published_ts", F.col("source.fetched_ts").alias("_poll")
        )
        raw = to_raw(polled, F.col("_poll"), algo)
    # Raw articles are small next to the documents, which are parsed once this way.
    return dedup_ttl(written(raw, "raw"), "id", "ingested_ts", options.dedup_ttl_s, tie=["title"])


def ingest_listing(
    pages: DataFrame,
    robots: DataFrame,
    as_of=None,
    options: IngestOptions = IngestOptions(),
    algo: str = "xxh64",
    order: str = "document",
) -> DataFrame:
    """New raw articles of fetched listing pages (`source, url, status, html`). Static input only."""
    allowed = robots_filter(successful_fetches(pages), robots, options.robots_rule)
    links = extract_links(
        allowed.select("source", "html"), options.link_domain, options.link_path_token, options.max_links_per_page, order
    )
    raw = to_raw(links.withColumn("published_ts", as_of_ms(as_of)), as_of, algo)
    return dedup_ttl(written(raw, "raw"), "id", "ingested_ts", options.dedup_ttl_s, tie=["title"])


def to_clean(raw_with_page: DataFrame, mode: str = "intent") -> DataFrame:
    """Clean articles of raw ones joined to their `html`, or to its parsed form in `_page`; the
    page's title wins over the feed's."""
    parsed = raw_with_page
    if "_page" not in parsed.columns:
        parsed = parsed.withColumn("_page", parse_html(F.col("html"), mode)).drop("html")
    body, title = F.col("_page.body"), F.col("_page.title")
    return parsed.select(
        "id",
        "source",
        "url",
        F.when(title != "", title).otherwise(F.col("title")).alias("title"),
        body.alias("body"),
        "published_ts",
        extract_hints(F.col("url"), body).alias("hints"),
        detect_language(body).alias("language"),
    )


def clean(
    raw: DataFrame,
    crawl: DataFrame,
    options: CleanOptions = CleanOptions(),
    mode: str = "intent",
    parse_first: bool = True,
) -> DataFrame:
    """Raw articles to clean ones: fetch result by URL, text, language and length filters.

    With `parse_first` pages are parsed before the join: once per page, however many articles
    share it. In batch, pages that no article names leave before they are parsed. Turn it off for a
    stream against a large crawl.
    """
    if parse_first:
        pages = successful_fetches(crawl).filter(F.col("html").isNotNull())
        if not raw.isStreaming and not crawl.isStreaming:
            pages = pages.join(raw.select("url"), "url", "left_semi")
        joined = raw.join(pages.select("url", parse_html(F.col("html"), mode).alias("_page")), "url")
    else:
        joined = attach_html(raw, crawl)
    articles = to_clean(joined, mode)
    return filter_min_body(filter_english(articles, options.require_english), options.min_body_bytes)


def article_topics(title: Column, body: Column) -> Column:
    """Rule topics of a whole article."""
    return topic_rules(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(TITLE_BREAK), F.coalesce(body, F.lit("")))))


def enrich(
    clean_articles: DataFrame,
    tickers: DataFrame,
    extractor: EntityExtractor | None = None,
    options: ResolveOptions = ResolveOptions(),
) -> DataFrame:
    """Clean articles to enriched ones; source and URL pass through."""
    found = with_tickers(clean_articles, tickers, extractor, options)
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(TITLE_BREAK), F.coalesce("body", F.lit("")))
    # The lower-cased text is a column of its own, so it is made once and not per keyword.
    return found.withColumn("_low", F.lower(whole)).select(
        "id", "title", "body", "published_ts", "tickers", "entities", topic_rules(F.col("_low")).alias("topics"), "source", "url"
    )


def scored_articles(
    raw: DataFrame,
    crawl: DataFrame,
    tickers: DataFrame,
    scorer: Scorer | None = None,
    extractor: EntityExtractor | None = None,
    as_of=None,
    clean_options: CleanOptions = CleanOptions(),
    resolve_options: ResolveOptions = ResolveOptions(),
    score_options: ScoreOptions = ScoreOptions(),
) -> DataFrame:
    """Raw articles to scored ones as one plan."""
    cleaned = clean(raw, crawl, clean_options)
    return score(enrich(cleaned, tickers, extractor, resolve_options), scorer, score_options, as_of)
