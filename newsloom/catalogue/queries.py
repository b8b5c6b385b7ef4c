"""The registered queries. Each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from newsloom.catalogue import tables as V
from newsloom.functions import display, hints, language, sentiment, strings, topics, urls
from newsloom.functions.ids import stable_id
from newsloom.operators import analytics, dedup, fuzzy, html, scoring
from newsloom.operators import tickers as resolve
from newsloom.plans import articles
from newsloom.settings import ScoreOptions, work_folder
from newsloom.sinks import tables as sinks
from newsloom.sources import crawl as crawls
from newsloom.sources import feeds
from newsloom.sources import scored as messages
from newsloom.sources.tickers import load_tickers
from newsloom.streaming import feeds as live_feeds
from newsloom.streaming import flows, metrics, state
from newsloom.streaming.running import run_until_idle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TTL_S = 172_800
HISTORY_END = "2024-01-16 00:00:00"


def registered(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def rounded(col: str | Column, digits: int = 6) -> Column:
    return F.round((F.col(col) if isinstance(col, str) else col).cast("double"), digits)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("sentiment", rounded("sentiment"))


# --- analytics over scored articles ---------------------------------------------------------


@registered
def latest(spark, sf_dir):
    return _shown(analytics.latest(V.scored(spark, sf_dir), 50))


@registered
def ops_latest(spark, sf_dir):
    return _shown(analytics.ops_latest(V.scored(spark, sf_dir), 50))


def _means(spark, sf_dir):
    return analytics.ticker_sentiment(V.scored(spark, sf_dir), V.whole_window(spark, sf_dir), 3, V.as_of(spark, sf_dir))


@registered
def ticker_sentiment(spark, sf_dir):
    return _means(spark, sf_dir).withColumn("avg_sent", rounded("avg_sent"))


@registered
def top_sentiment_pos(spark, sf_dir):
    return analytics.movers(_means(spark, sf_dir)).positives.withColumn("avg_sent", rounded("avg_sent"))


@registered
def top_sentiment_neg(spark, sf_dir):
    return analytics.movers(_means(spark, sf_dir)).negatives.withColumn("avg_sent", rounded("avg_sent"))


@registered
def top_sentiment_ends(spark, sf_dir):
    ends = analytics.top_sentiment_ends(V.scored(spark, sf_dir), 1440, 3, V.as_of(spark, sf_dir))
    return ends.withColumn("avg_sent", rounded("avg_sent"))


@registered
def top_movers_display(spark, sf_dir):
    best = analytics.movers(_means(spark, sf_dir), analytics.DISPLAY_MOVERS).positives
    return best.select("ticker", display.round2(F.col("avg_sent")).alias("shown"), "n")


@registered
def minute_series(spark, sf_dir):
    series = analytics.minute_series(V.scored(spark, sf_dir), V.whole_window(spark, sf_dir), V.as_of(spark, sf_dir))
    return series.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "n")


@registered
def source_counts(spark, sf_dir):
    return analytics.source_counts(V.scored(spark, sf_dir), V.whole_window(spark, sf_dir), V.as_of(spark, sf_dir))


@registered
def topic_counts(spark, sf_dir):
    return analytics.topic_counts(V.scored(spark, sf_dir), V.whole_window(spark, sf_dir), V.as_of(spark, sf_dir))


@registered
def stat_cards(spark, sf_dir):
    """Both count lists as label and number, cut to what a card shows."""
    stats = analytics.stats(V.scored(spark, sf_dir), V.whole_window(spark, sf_dir), V.as_of(spark, sf_dir))
    none = F.lit(None).cast("string")
    by_source = stats.sources.withColumn("topic", none).limit(analytics.DISPLAY_STATS)
    by_topic = stats.topics.withColumn("source", none).limit(analytics.DISPLAY_STATS)
    both = by_source.withColumn("card", F.lit("sources")).unionByName(by_topic.withColumn("card", F.lit("topics")))
    return both.select(
        "card",
        display.stat_label(F.col("source"), F.col("topic")).alias("label"),
        display.stat_count(F.col("n")).alias("n"),
    )


@registered
def query_parameters(spark, sf_dir):
    """The lists at parameters beyond their caps: they come out at the caps."""
    rows = V.scored(spark, sf_dir)
    newest = analytics.latest(rows, 10_000).select(F.lit("latest").alias("query"), F.col("id").alias("label"))
    means = analytics.ticker_sentiment(rows, analytics.clamp(10_000_000, analytics.WINDOW_CAP), analytics.clamp(10_000, analytics.MIN_COUNT_CAP), V.as_of(spark, sf_dir))
    feed = analytics.ticker_feed_query(analytics.ticker_feed(rows, 1_000, 604_800, V.as_of(spark, sf_dir)), "T3", 10_000)
    return newest.unionByName(means.select(F.lit("means").alias("query"), F.col("ticker").alias("label"))).unionByName(feed.select(F.lit("feed").alias("query"), F.col("id").alias("label")))


def _feed(spark, sf_dir):
    return analytics.ticker_feed(V.scored(spark, sf_dir), 50, 604_800, V.as_of(spark, sf_dir))


@registered
def ticker_feed(spark, sf_dir):
    return _feed(spark, sf_dir).select("ticker", "rank", "id", "title", rounded("sentiment").alias("sentiment"), "ts")


@registered
def ticker_feed_query(spark, sf_dir):
    feed = analytics.ticker_feed_query(_feed(spark, sf_dir), "t3", 20)
    return feed.select("ticker", "rank", "id", "title", rounded("sentiment").alias("sentiment"), "ts")


@registered
def live_merge(spark, sf_dir):
    """Purchases and signups as the live rows, all articles as the stored ones."""
    live = V.scored_messages(V.table(spark, sf_dir, "events")).filter(F.col("source").isin("purchase", "signup"))
    live = live.withColumn("title", F.concat(F.lit("live "), "title"))
    merged = analytics.merge_live(live, V.scored(spark, sf_dir))
    return merged.select(
        "id", "title", "time_ms", rounded("sentiment").alias("sentiment"),
        sentiment.sentiment_band(F.col("sentiment")).alias("band"),
    )


@registered
def sentiment_band(spark, sf_dir):
    s = F.col("sentiment")
    rows = V.scored_messages(V.table(spark, sf_dir, "events"))
    return rows.select(
        "id",
        sentiment.sentiment_band(s).alias("band"),
        sentiment.sentiment_sign(s).alias("sign"),
        display.round2(s).alias("shown"),
        display.display_time(F.col("scored_ts")).alias("time"),
    )


# --- first-seen filters ------------------------------------------------------------------------


@registered
def dedup_ttl(spark, sf_dir):
    events = V.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return dedup.dedup_ttl(events, ["user_id", "event_type"], "ts", TTL_S, tie=["event_id"])


@registered
def dedup_ttl_sliced(spark, sf_dir):
    """Few keys with very many rows each and a TTL of a minute: kept times by pointer doubling."""
    events = V.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return dedup.dedup_ttl(events, "event_type", "ts", 60, tie=["event_id"], fold_limit=100)


def _keyed_events(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(
        "event_id", "ts", F.concat_ws("/", "user_id", "event_type").alias("key")
    )


@registered
def dedup_history(spark, sf_dir):
    """Events from a day on as the load, all earlier ones as what was kept before."""
    events, day = _keyed_events(spark, sf_dir), F.expr(f"TIMESTAMP_NTZ '{HISTORY_END}'")
    return dedup.new_articles(events.filter(F.col("ts") >= day), events.filter(F.col("ts") < day), TTL_S, key="key")


@registered
def dedup_backfill(spark, sf_dir):
    """Six days loaded late: the history has earlier rows, later ones, and a third of the days' own."""
    events, start, end = _keyed_events(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-10'"), F.expr(f"TIMESTAMP_NTZ '{HISTORY_END}'")
    inside = (F.col("ts") >= start) & (F.col("ts") < end)
    return dedup.new_articles(events.filter(inside), events.filter(~inside | (F.col("event_id") % 3 == 0)), TTL_S, key="key")


# --- URLs, ids, feeds and pages --------------------------------------------------------------


@registered
def normalize_url(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@registered
def url_host(spark, sf_dir):
    u = F.col("url")
    return V.table(spark, sf_dir, "pages").select(
        "page_id", urls.url_host(u).alias("host"), urls.url_host(F.substring_index(u, "://", -1), schemeless=True).alias("bare_host")
    )


@registered
def path_tokens(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", urls.path_tokens(F.col("url")).alias("tokens"))


@registered
def stable_id_md5(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(
        "page_id", stable_id(F.lit("crawl"), urls.normalize_url(F.col("url")), "md5").alias("id")
    )


@registered
def stable_id_xxh64(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(
        "page_id", stable_id(F.lit("crawl"), urls.normalize_url(F.col("url"))).alias("id")
    )


def _raw_pages(spark, sf_dir):
    return articles.to_raw(V.pages_as_items(V.table(spark, sf_dir, "pages")), V.AS_OF_MS)


def _new_pages(spark, sf_dir):
    return dedup.dedup_ttl(_raw_pages(spark, sf_dir), "id", "ingested_ts", TTL_S, tie=["title"])


@registered
def ingest_raw(spark, sf_dir):
    return _raw_pages(spark, sf_dir)


@registered
def feed_items_rss(spark, sf_dir):
    return feeds.rss_items(V.documents_as_feeds(spark, sf_dir, "rss"), as_of=V.AS_OF_MS)


@registered
def feed_items_atom(spark, sf_dir):
    return feeds.atom_items(V.documents_as_feeds(spark, sf_dir, "atom"), as_of=V.AS_OF_MS)


@registered
def feed_items(spark, sf_dir):
    return feeds.feed_items(V.documents_as_feeds(spark, sf_dir, "mixed"), as_of=V.AS_OF_MS)


@registered
def ingest_batch(spark, sf_dir):
    """Feeds of all documents, polled an hour apart, to new raw articles: a repeated text passes
    again only two days after it was last accepted."""
    return articles.ingest_batch(V.documents_as_feeds(spark, sf_dir, "mixed"), as_of=V.AS_OF_MS, algo="md5")


@registered
def expand_feeds(spark, sf_dir):
    """Document sources as the configured feeds, plus one feed per nation."""
    configured = (
        V.table(spark, sf_dir, "documents")
        .select("source", F.concat(F.lit("https://feeds.example.com/"), "source").alias("url"))
        .distinct()
    )
    return feeds.expand_feeds(
        configured, V.table(spark, sf_dir, "nation"), "https://example.com/rss?s={TICKER}&again={TICKER}", "PerTicker:", "n_name"
    )


def _crawl_with_status(spark, sf_dir):
    """Pages whose URL has a fragment stand for failed fetches."""
    status = F.when(F.contains("url", F.lit("#")), F.lit(404)).otherwise(F.lit(200))
    return V.table(spark, sf_dir, "pages").withColumn("status", status)


@registered
def fetch_ok(spark, sf_dir):
    return crawls.successful_fetches(_crawl_with_status(spark, sf_dir)).select("page_id", "url", "status")


@registered
def robots_filter(spark, sf_dir):
    """Robots texts by host: `.org` hosts forbid the path, `.net` hosts do not answer."""
    pages = V.table(spark, sf_dir, "pages").select("page_id", "url")
    host = urls.url_host(F.col("url"))
    robots = pages.select(host.alias("host")).distinct()
    robots = robots.select(
        "host",
        F.when(F.endswith("host", F.lit(".net")), 404).otherwise(200).alias("status"),
        F.when(F.endswith("host", F.lit(".com")), "User-agent: *\nAllow: /").otherwise("User-Agent: *\nDISALLOW: /quote/").alias("body"),
    )
    return crawls.robots_filter(pages, robots)


def _listing_pages(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", "html")


@registered
def extract_links(spark, sf_dir):
    """Every navigation link counts as news here: domain and path test are both a slash."""
    return html.extract_links(_listing_pages(spark, sf_dir), "/", "/", 5)


@registered
def extract_links_reverse(spark, sf_dir):
    return html.extract_links(_listing_pages(spark, sf_dir), "/", "/", 5, order="reverse_dfs")


@registered
def extract_links_of_site(spark, sf_dir):
    """Only links into one section of one site count; links of the site without a scheme get one."""
    linked = F.regexp_replace("html", '<a href="/t', '<a href="//example.com/News/t')
    linked = F.regexp_replace(linked, '<a href="/d', '<a href="https://EXAMPLE.com/news/d')
    linked = F.regexp_replace(linked, '<a href="/e', '<a href="http://example.com/sport/e')
    pages = V.table(spark, sf_dir, "pages").select("page_id", linked.alias("html"))
    return html.extract_links(pages, "example.com", "/news/", 30)


@registered
def ingest_listing(spark, sf_dir):
    pages = _crawl_with_status(spark, sf_dir).withColumn("source", F.concat(F.lit("listing:"), "page_id"))
    robots = pages.select(urls.url_host(F.col("url")).alias("host")).distinct()
    robots = robots.select(
        "host", F.lit(200).alias("status"),
        F.when(F.endswith("host", F.lit(".org")), "Disallow: /quote/").otherwise("").alias("body"),
    )
    options = articles.IngestOptions(link_domain="/", link_path_token="/")
    return articles.ingest_listing(pages, robots, V.AS_OF_MS, options, algo="md5")


# --- cleaning ------------------------------------------------------------------------------------


@registered
def extract_title(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", html.extract_title(F.col("html")).alias("title"))


@registered
def main_text(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", html.main_content(F.col("html")).alias("body"))


@registered
def main_text_sibling_tail(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(
        "page_id", html.main_content(F.col("html"), "sibling_tail").alias("body")
    )


@registered
def strip_nontext(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select("page_id", html.strip_nontext(F.col("html")).alias("html"))


@registered
def clean_articles(spark, sf_dir):
    return articles.clean(_new_pages(spark, sf_dir), V.pages_as_crawl(V.table(spark, sf_dir, "pages")))


@registered
def detect_language(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select("doc_id", language.detect_language(F.col("text")).alias("language"))


@registered
def filter_clean(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("body"), language.detect_language(F.col("text")).alias("language")
    )
    return language.filter_min_body(language.filter_english(docs), 200).select("doc_id", F.octet_length("body").alias("n_bytes"))


# --- enrichment ----------------------------------------------------------------------------------


@registered
def article_hints(spark, sf_dir):
    return V.clean_documents(spark, sf_dir).select("id", "hints")


@registered
def cashtags(spark, sf_dir):
    docs = V.documents_as_clean(spark, sf_dir)
    found = hints.extract_cashtags(F.concat("title", F.lit(" "), "body"))
    return docs.select("id", F.sort_array(found).alias("cashtags"))


def _with_topics(docs: DataFrame) -> DataFrame:
    whole = F.lower(F.concat("title", F.lit(strings.TITLE_BREAK), "body"))
    return docs.withColumn("_low", whole).select("*", topics.topic_rules(F.col("_low")).alias("topics"))


@registered
def topic_rules(spark, sf_dir):
    return _with_topics(V.documents_as_clean(spark, sf_dir)).select("id", "topics")


@registered
def merge_topics(spark, sf_dir):
    """Topics of the whole article with those of the text a model sees."""
    docs = _with_topics(V.documents_as_clean(spark, sf_dir))
    docs = docs.withColumn("_seen", F.lower(strings.model_text(F.col("title"), F.col("body"))))
    model = F.concat(topics.topic_rules(F.col("_seen")), F.array(F.lit("news")))
    return docs.select("id", topics.merge_topics(F.col("topics"), model).alias("topics"))


@registered
def topics_pipe(spark, sf_dir):
    docs = _with_topics(V.documents_as_clean(spark, sf_dir))
    piped = docs.select("id", strings.topics_pipe(F.col("topics")).alias("piped"))
    return piped.select("id", "piped", strings.topics_split(F.col("piped")).alias("split"))


@registered
def ticker_file(spark, sf_dir):
    """A dictionary file of all nations, written as people write them and read back: blanks, doubled and empty aliases, lower case."""
    folder, nation = work_folder(spark, "ticker-file"), V.table(spark, sf_dir, "nation")
    rows = nation.orderBy("n_nationkey").select(
        F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("symbol"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.initcap("n_name"), F.lit(", Inc"))).alias("name"),
        F.concat(F.initcap("n_name"), F.lit("; Region "), "n_regionkey", F.lit(";;Region "), "n_regionkey", F.lit(" ;")).alias("aliases"),
    )
    rows.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    return load_tickers(spark, folder)


@registered
def score_tickers(spark, sf_dir):
    scored = resolve.score_tickers(V.clean_documents(spark, sf_dir), V.tickers(spark))
    return scored.select("id", F.explode("ticker_scores").alias("s")).select("id", "s.symbol", "s.score")


@registered
def resolve_tickers(spark, sf_dir):
    return resolve.resolve_tickers(V.clean_documents(spark, sf_dir), V.tickers(spark)).select("id", "tickers")


@registered
def resolve_tickers_joined(spark, sf_dir):
    """The dictionary dealt into parts of one symbol each, as a very large one is, and their results joined."""
    docs = V.clean_documents(spark, sf_dir)
    return resolve.resolve_tickers(docs, V.tickers(spark), part_letters=1).select("id", "tickers")


@registered
def resolve_tickers_large(spark, sf_dir):
    """Documents whose title is their whole text, against a dictionary of all customers and all documents' first letters."""
    docs = V.clean_documents(spark, sf_dir).withColumn("title", F.col("body"))
    return resolve.resolve_tickers(docs, V.tickers_large(spark, sf_dir)).select("id", "tickers")


@registered
def alias_owner(spark, sf_dir):
    """How often each alias occurs in the documents, with the symbol it stands for."""
    from newsloom.sources.tickers import alias_owner as owners

    docs = V.documents_as_clean(spark, sf_dir)
    names = strings.string_array(sorted({r[1] for r in V.TICKER_ROWS} | {a for r in V.TICKER_ROWS for a in r[2].split(";")}))
    held = docs.select("id", F.explode(F.filter(names, lambda a: F.contains(F.col("body"), a))).alias("alias"))
    counts = held.groupBy("alias").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(owners(V.tickers(spark)), "alias")


@registered
def fuzzy_match(spark, sf_dir):
    docs = V.documents_as_clean(spark, sf_dir)
    text = strings.entity_text(F.col("title"), F.col("body"))
    mentions = docs.select("id", F.explode(resolve.CapitalizedRuns().mentions(text)).alias("mention"))
    found = fuzzy.fuzzy_match(mentions, V.tickers(spark))
    return found.filter(F.col("symbol").isNotNull()).withColumn("score", rounded("score"))


@registered
def enrich_entities(spark, sf_dir):
    docs = V.clean_documents(spark, sf_dir)
    names = sorted({r[1] for r in V.TICKER_ROWS})
    return articles.enrich(docs, V.tickers(spark), resolve.CapitalizedRuns(names)).select("id", "entities", "tickers", "topics")


# --- scoring -------------------------------------------------------------------------------------


@registered
def softmax_sentiment(spark, sf_dir):
    logits = F.slice("embedding", 1, 3)
    rows = V.table(spark, sf_dir, "embeddings").select(
        "vec_id", sentiment.sentiment_from_logits(logits).alias("s"), sentiment.softmax(logits).alias("p")
    )
    return rows.select(
        "vec_id",
        rounded("s.sentiment").alias("sentiment"),
        rounded("s.confidence").alias("confidence"),
        rounded(F.get("p", F.lit(1))).alias("p_neutral"),
    )


def _scored_docs(docs: DataFrame) -> DataFrame:
    scored = scoring.score(docs, as_of=V.AS_OF_MS)
    return scored.withColumns({"sentiment": rounded("sentiment", 5), "confidence": rounded("confidence", 5)})


@registered
def score_lexicon(spark, sf_dir):
    docs = V.documents_as_clean(spark, sf_dir).withColumns({"tickers": strings.empty_strings(), "topics": strings.empty_strings()})
    return _scored_docs(docs).select("id", "sentiment", "confidence", "topics")


@registered
def score_hashed(spark, sf_dir):
    """A batch scorer with weights made by a rule and its labels in another order."""
    docs = V.documents_as_clean(spark, sf_dir).withColumns({"tickers": strings.empty_strings(), "topics": strings.empty_strings()})
    scorer = scoring.HashedLinearScorer(spark, V.hashed_weights(), V.HASHED_LABELS)
    scored = scoring.score(docs, scorer, ScoreOptions(enable_rules=False), as_of=V.AS_OF_MS)
    return scored.select("id", rounded("sentiment", 5).alias("sentiment"), rounded("confidence", 5).alias("confidence"), "topics")


@registered
def enrich_score(spark, sf_dir):
    docs = V.clean_documents(spark, sf_dir)
    return _scored_docs(articles.enrich(docs, V.tickers(spark)))


@registered
def zip_scores(spark, sf_dir):
    """Topics of each article zipped with its tickers as if they were its scores."""
    rows = V.scored(spark, sf_dir)
    zipped = rows.select("id", F.posexplode(scoring.zip_scores(F.col("topics"), F.col("tickers"))).alias("pos", "z"))
    return zipped.select("id", "pos", F.col("z.s0").alias("topic"), F.col("z.s1").alias("ticker"))


# --- messages and sinks --------------------------------------------------------------------------


def _payloads(spark, sf_dir):
    return messages.to_scored_json(V.scored_messages(V.table(spark, sf_dir, "events")))


@registered
def scored_json_roundtrip(spark, sf_dir):
    rows = messages.parse_scored_json(_payloads(spark, sf_dir))
    return _shown(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _odd_payloads(spark, sf_dir):
    """Messages of which two thirds are damaged: no JSON, no object, fields missing, null or of a wrong type."""
    kind, n = F.col("event_id") % 12, F.col("event_id").cast("string")
    text = (
        F.when(kind == 0, F.concat(F.lit('{"id":"'), n, F.lit('","tickers":["A","B"],"sentiment":0.5,"scored_ts":'), n, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"id":"'), n, F.lit('"')))
        .when(kind == 2, F.concat(F.lit("["), n, F.lit("]")))
        .when(kind == 3, F.lit("null"))
        .when(kind == 4, F.concat(F.lit('{"id":'), n, F.lit(',"tickers":"A","topics":null,"sentiment":"x"}')))
        .when(kind == 5, F.lit("{}"))
        .when(kind == 6, F.concat(F.lit('{"title":"t'), n, F.lit('","tickers":null,"scored_ts":"soon"}')))
        .when(kind == 7, F.lit(None).cast("string"))
        .when(kind == 8, F.lit(""))
        .when(kind == 9, F.concat(F.lit('{"id":null,"url":"u'), n, F.lit('","extra":{"a":1},"tickers":[],"scored_ts":1.5}')))
        .when(kind == 10, F.concat(F.lit('{"source":"s'), n, F.lit('","tickers":["C"],"topics":["x","y"]}')))
        .otherwise(F.concat(F.lit("text "), n))
    )
    return V.table(spark, sf_dir, "events").select("event_id", text.alias("payload"))


@registered
def odd_payloads_table(spark, sf_dir):
    rows = _shown(messages.parse_scored_json(_odd_payloads(spark, sf_dir)))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@registered
def odd_payloads_record(spark, sf_dir):
    return _shown(messages.to_record(_odd_payloads(spark, sf_dir)))


@registered
def odd_payloads_feed(spark, sf_dir):
    """Messages whose tickers are a list go on to the feeds."""
    return messages.parse_feed_json(_odd_payloads(spark, sf_dir)).select("payload", "id", "tickers")


@registered
def archive_record(spark, sf_dir):
    return _shown(messages.to_record(_payloads(spark, sf_dir)))


def _archived(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    schema = sinks.with_hour(V.scored_messages(V.table(spark, sf_dir, "events"))).schema
    return _shown(spark.read.schema(schema).parquet(folder))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(messages.read_news_scored(spark, folder)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@registered
def hourly_archive(spark, sf_dir):
    """Written and read back, with the hour of each row's folder."""
    folder = work_folder(spark, "archive")
    sinks.write_hourly_archive(V.scored_messages(V.table(spark, sf_dir, "events")), folder)
    return _archived(spark, sf_dir, folder)


@registered
def daily_table(spark, sf_dir):
    """Written and read back through the table reader."""
    folder = work_folder(spark, "news-scored")
    sinks.write_news_scored(V.scored(spark, sf_dir), folder)
    return _stored(spark, folder)


# --- streams -------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # A pattern, since a stream source takes a bare path for a folder and the table may be one file.
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run_to_files(df: DataFrame, purpose: str) -> DataFrame:
    """Run an append stream over everything available and read its output back."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession, purpose)
    query = (
        df.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run_until_idle(query, empty_batches=1)
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _run_updates(df: DataFrame, purpose: str) -> DataFrame:
    """Run an update stream; every micro-batch's updates are kept with its number as `batch`."""
    spark, folder = df.sparkSession, work_folder(df.sparkSession, purpose)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = (
        df.writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run_until_idle(query, empty_batches=1)
    return spark.read.option("basePath", f"{folder}/out").schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).parquet(f"{folder}/out")


def _in_batches(spark: SparkSession, purpose: str, inputs: dict[str, list[DataFrame]], start: Callable[[dict[str, DataFrame], str], StreamingQuery]) -> str:
    """Feeds the parts of each input one after the other to a stream that stops and goes on after
    each, so it takes a micro-batch or more per part. Returns the work folder."""
    folder = work_folder(spark, purpose)
    for step in range(max(map(len, inputs.values()))):
        for name, parts in inputs.items():
            if step < len(parts):
                parts[step].write.mode("append").parquet(f"{folder}/in/{name}")
        streams = {name: spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in/{name}") for name, parts in inputs.items()}
        run_until_idle(start(streams, folder), empty_batches=1)
    return folder


def _to_files(df: DataFrame, folder: str) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(availableNow=True).start()


def _event_parts(spark: SparkSession, sf_dir: str, late: bool = False) -> list[DataFrame]:
    """All events in three spans of time; with `late`, half of the last five minutes of a span come with the next."""
    events = V.table(spark, sf_dir, "events")
    ends = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("first"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last")).first()
    first, last = ends["first"] or 0, ends["last"] or 0
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    if late:
        at = at + F.when(F.col("event_id") % 2 == 0, 300_000_000).otherwise(0)
    cuts = [first + (last - first) * i // 3 for i in (1, 2)]
    return [events.where(at < cuts[0]), events.where((at >= cuts[0]) & (at < cuts[1])), events.where(at >= cuts[1])]


@registered
def stream_dedup(spark, sf_dir):
    events = _stream(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", "event_type").alias("key")
    )
    kept = _run_to_files(state.dedup_stream(events, "key", TTL_S, order=("ts", "event_id")), "stream-dedup")
    return kept.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@registered
def stream_dedup_event_time(spark, sf_dir):
    """The rows that survive over several micro-batches: a key accepted in one is suppressed and accepted again in later ones."""

    def start(streams, folder):
        events = streams["events"].select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", "event_type").alias("key")
        )
        return _to_files(state.dedup_stream_event_time(events, "key", "ts", TTL_S, order=("event_id",)), folder)

    folder = _in_batches(spark, "stream-dedup-event", {"events": _event_parts(spark, sf_dir)}, start)
    kept = spark.read.schema("event_id bigint, ts timestamp, key string").parquet(f"{folder}/out")
    return kept.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _last_update(rows: DataFrame, *keys: str) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


@registered
def stream_minute_counts(spark, sf_dir):
    counts = metrics.live_minute_counts(_stream(spark, sf_dir, "events"))
    last = _last_update(_run_updates(counts, "stream-minutes"), "minute")
    return last.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "n")


def _windows(spark: SparkSession, sf_dir: str, purpose: str, metric: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Closed windows of an hour by a minute over all events, which come in three parts with late rows."""
    folder = _in_batches(spark, purpose, {"events": _event_parts(spark, sf_dir, late=True)}, lambda streams, folder: _to_files(metric(V.scored_of(streams["events"])), folder))
    out = spark.read.schema(metric(V.scored(spark, sf_dir)).schema).parquet(f"{folder}/out")
    return out.withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@registered
def stream_ticker_sentiment(spark, sf_dir):
    means = _windows(spark, sf_dir, "stream-means", lambda rows: metrics.live_ticker_sentiment(rows, min_count=1))
    return means.withColumn("avg_sent", rounded("avg_sent"))


@registered
def stream_topic_counts(spark, sf_dir):
    return _windows(spark, sf_dir, "stream-topics", lambda rows: metrics.live_label_counts(rows, "topics"))


@registered
def stream_ticker_feed(spark, sf_dir):
    """Feeds over three micro-batches; one ticker is on every second row."""

    def start(streams, folder):
        rows = V.scored_messages(streams["events"]).withColumn("payload", F.lpad("id", 12, "0"))
        hot = F.when(F.col("id").cast("bigint") % 2 == 0, strings.string_array(["HOT"])).otherwise(strings.empty_strings())
        rows = rows.withColumn("tickers", F.concat("tickers", hot))
        return live_feeds.start_ticker_feed(rows, f"{folder}/feed", f"{folder}/checkpoint", trigger={"availableNow": True})

    folder = _in_batches(spark, "stream-feed", {"events": _event_parts(spark, sf_dir)}, start)
    return live_feeds.read_feed(spark, f"{folder}/feed")


@registered
def stream_scored_ingest(spark, sf_dir):
    """All rows of the table that three micro-batches fill."""

    def start(streams, folder):
        payloads = messages.to_scored_json(V.scored_messages(streams["events"]))
        return flows.start_scored_ingest(payloads, f"{folder}/table", f"{folder}/checkpoint", {"availableNow": True})

    return _stored(spark, _in_batches(spark, "stream-ingest", {"events": _event_parts(spark, sf_dir)}, start) + "/table")


@registered
def stream_archive(spark, sf_dir):
    """All rows of the archive that three micro-batches fill, late ones in their own hours."""

    def start(streams, folder):
        payloads = messages.to_scored_json(V.scored_messages(streams["events"]))
        return flows.archive_stream(payloads, f"{folder}/archive", f"{folder}/checkpoint", trigger={"availableNow": True})

    return _archived(spark, sf_dir, _in_batches(spark, "stream-archive", {"events": _event_parts(spark, sf_dir, late=True)}, start) + "/archive")


@registered
def stream_articles(spark, sf_dir):
    """Raw articles and fetched pages as two streams of several micro-batches each, joined, cleaned,
    enriched and scored; the parts are dealt so that an article and its page often come apart."""
    pages = V.table(spark, sf_dir, "pages")
    raw = articles.to_raw(V.pages_as_items(pages), V.AS_OF_MS)
    crawl = V.pages_as_crawl(pages).withColumn("fetched_ts", F.lit(V.AS_OF_MS) + F.pmod(F.xxhash64("url"), F.lit(60)) * 60_000)

    def dealt(df: DataFrame, seed: str) -> list[DataFrame]:
        return [df.where(F.pmod(F.xxhash64(F.lit(seed), "url"), F.lit(3)) == i) for i in range(3)]

    def first_seen(streams, folder):
        return _to_files(state.dedup_stream(streams["raw"], "id", TTL_S, order=("title",)), folder)

    fresh = spark.read.schema(raw.schema).parquet(_in_batches(spark, "stream-raw", {"raw": dealt(raw, "raw")}, first_seen) + "/out")

    def start(streams, folder):
        return _to_files(flows.article_stream(streams["raw"], streams["crawl"], V.tickers(spark), as_of=V.AS_OF_MS), folder)

    folder = _in_batches(spark, "stream-articles", {"raw": dealt(fresh, "fresh"), "crawl": dealt(crawl, "crawl")}, start)
    schema = articles.scored_articles(raw, crawl, V.tickers(spark), as_of=V.AS_OF_MS).schema
    back = spark.read.schema(schema).parquet(f"{folder}/out")
    return back.withColumns({"sentiment": rounded("sentiment", 5), "confidence": rounded("confidence", 5)})


@registered
def scored_pages(spark, sf_dir):
    """The batch form of the same chain of stages."""
    scored = articles.scored_articles(
        _new_pages(spark, sf_dir), V.pages_as_crawl(V.table(spark, sf_dir, "pages")), V.tickers(spark), as_of=V.AS_OF_MS
    )
    return scored.withColumns({"sentiment": rounded("sentiment", 5), "confidence": rounded("confidence", 5)})
