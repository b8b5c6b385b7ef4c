"""Feeds, crawl gates, payloads and sinks."""

import glob
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.plans import articles
from newsloom.sinks.tables import write_hourly_archive, write_news_scored
from newsloom.sources import crawl, feeds, scored, topic

FEEDS = [
    ("rss", "<rss><channel><title>c</title><item><title>A &amp; B</title><link>http://x/1</link><link>http://x/2</link></item>"
            "<item><title>no link</title></item></channel></rss>"),
    ("caps", "<?xml version='1.0'?>\n<!-- c --><RSS><CHANNEL><ITEM><TITLE>T</TITLE><LINK>L</LINK>"
             "<pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></ITEM></CHANNEL></RSS>"),
    ("cdata", "<rss><channel><item><title><![CDATA[a <b> c]]></title><link>l</link><pubDate>bad</pubDate></item></channel></rss>"),
    ("atom", "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>E</title><link rel='a'/><link href='h1'/><link href='h2'/>"
             "<published>2024-01-01T01:00:00+01:00</published></entry><entry><title>x</title><link rel='a'/></entry></feed>"),
    ("rdf", "<rdf:RDF xmlns:rdf='u'><channel><title>c</title></channel><item><title>R</title><link>r</link></item></rdf:RDF>"),
    ("html", "<html><channel><item><title>R</title><link>r</link></item></channel></html>"),
    ("text", "not xml"), ("cut", "<rss><channel><item><title>A</title>"), ("empty", ""), ("null", None),
]


@pytest.fixture(scope="module")
def feed_docs(spark):
    return spark.createDataFrame(FEEDS, "source string, xml string")


def items(df):
    return sorted((r["source"], r["title"], r["link"], r["published_ts"]) for r in df.collect())


def test_feed_items(feed_docs):
    expected = [("atom", "E", "h1", 5), ("caps", "T", "L", 5), ("cdata", "a <b> c", "l", 5), ("rdf", "R", "r", 5), ("rss", "A & B", "http://x/1", 5)]
    assert items(feeds.feed_items(feed_docs, as_of=5)) == expected
    both = feeds.rss_items(feed_docs, as_of=5).unionByName(feeds.atom_items(feed_docs, as_of=5))
    assert items(both) == expected


def test_prologs_and_blanks(spark):
    item = "<item><title> a </title><link>l</link></item><item><title> </title><link>m</link></item>"
    rss = f"<rss><channel>{item}</channel></rss>"
    subset = "<!DOCTYPE rss [ <!ELEMENT rss (channel)> <!-- ]> --> <!ENTITY x 'y>'> ]>"
    docs = [("bom", "\ufeff" + rss), ("mark", "\ufeff<?xml version='1.0'?>\n" + rss), ("subset", subset + rss),
            ("many", "<!-- c -->" * 5_000 + rss), ("open", "<!-- " * 5_000), ("text", "<!-- c -->" * 5_000 + "text")]
    found = feeds.feed_items(spark.createDataFrame(docs, "source string, xml string"), as_of=5).collect()
    assert sorted((r.source, r.title, r.link) for r in found) == sorted((s, t, k) for s in ("bom", "mark", "subset", "many") for t, k in ((" a ", "l"), (" ", "m")))


def test_parsed_times(feed_docs):
    times = {r["source"]: r["published_ts"] for r in feeds.feed_items(feed_docs, published="parse", as_of=5).collect()}
    assert times == {"atom": 1_704_067_200_000, "caps": 1_704_067_200_000, "cdata": 5, "rdf": 5, "rss": 5}
    with pytest.raises(ValueError):
        feeds.feed_items(feed_docs, published="guess")


def test_feed_parsing_stays_in_the_jvm(feed_docs, plan):
    text = plan(feeds.feed_items(feed_docs, as_of=5))
    assert "EvalPython" not in text and "Exchange" not in text


def test_expand_feeds(spark):
    base = spark.createDataFrame([("a", "u")], schemas.FEEDS_SCHEMA)
    symbols = spark.createDataFrame([("X",), ("Y",)], "symbol string")
    out = feeds.expand_feeds(base, symbols, "http://h/{TICKER}?t={TICKER}", "P:")
    assert sorted(map(tuple, out.collect())) == [("P:X", "http://h/X?t=X"), ("P:Y", "http://h/Y?t=Y"), ("a", "u")]


def test_crawl_gates(spark):
    pages = spark.createDataFrame([("http://A.com/1", 200, "h"), ("http://b.com/2", 299, "h"), ("http://c.com", 301, "h"), ("http://d.com", None, None)], schemas.CRAWL_SCHEMA)
    assert {r["url"] for r in crawl.successful_fetches(pages).collect()} == {"http://A.com/1", "http://b.com/2"}
    robots = spark.createDataFrame([("a.com", 200, "X\nDISALLOW: /Quote/"), ("b.com", 404, "disallow: /quote/"), ("c.com", 200, None)], schemas.ROBOTS_SCHEMA)
    assert {r["url"] for r in crawl.robots_filter(pages, robots).collect()} == {"http://b.com/2", "http://c.com", "http://d.com"}


def test_ingest_polls(spark):
    hour, xml = 3_600_000, "<rss><channel><item><title>t</title><link>http://www.x.com/a/?utm_source=q</link></item></channel></rss>"
    docs = spark.createDataFrame([("s", xml, h * hour) for h in (1, 20, 48, 49, 97)] + [("other", xml, hour)], "source string, xml string, fetched_ts bigint")
    rows = sorted((r["source"], r["ingested_ts"] // hour, r["url"]) for r in articles.ingest_batch(docs).collect())
    assert rows == [("other", 1, "http://x.com/a"), ("s", 1, "http://x.com/a"), ("s", 49, "http://x.com/a"), ("s", 97, "http://x.com/a")]
    assert articles.ingest_batch(docs).schema.names == schemas.RAW_SCHEMA.names


def test_clean_stage(spark):
    body = "word " * 60
    page = "<title>{t}</title><article><p>" + body + "</article>"
    raw = spark.createDataFrame([(str(i), "s", f"http://h/{i}", "feed title", "", i, 0) for i in range(5)], schemas.RAW_SCHEMA)
    fetched = spark.createDataFrame(
        [("http://h/0", 200, page.format(t="page title")), ("http://h/1", 200, page.format(t="")), ("http://h/2", 500, page),
         ("http://h/3", 200, "<article>short</article>"), ("http://h/4", 200, "<article>" + "é" * 300 + "</article>")], schemas.CRAWL_SCHEMA)
    rows = {r["id"]: r for r in articles.clean(raw, fetched).collect()}
    assert {i: r["title"] for i, r in rows.items()} == {"0": "page title", "1": "feed title"}
    assert rows["0"]["body"] == body.strip() and rows["0"]["hints"] == ["host:h"] and rows["0"]["language"] == "en"
    loose = articles.CleanOptions(require_english=False, min_body_bytes=0)
    assert articles.clean(raw, fetched, loose).count() == 4


@pytest.mark.parametrize("parse_first", [True, False])
def test_pages_are_parsed_once(spark, parse_first, plan):
    raw = spark.createDataFrame([("1", "s", "http://h/1", "t", "", 0, 0)], schemas.RAW_SCHEMA)
    pages = spark.createDataFrame([("http://h/1", 200, "<article>" + "word " * 99)], schemas.CRAWL_SCHEMA)
    cleaned = articles.clean(raw, pages, parse_first=parse_first)
    assert cleaned.count() == 1
    assert cleaned._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1


PAYLOADS = [
    "{}", "not json", "[1]", '{"id":"a","tickers":"x","sentiment":0.5,"scored_ts":1700000000123}',
    '{"id":"b","tickers":["T"],"sentiment":1,"topics":null,"title":"t"}',
]


def test_payload_defaults(spark):
    df = spark.createDataFrame([(p,) for p in PAYLOADS], "payload string")
    table = {r["id"]: r for r in scored.parse_scored_json(df).collect()}
    assert set(table) == {"", "a", "b"} and table["a"]["tickers"] == [] and table["b"]["topics"] == []
    assert table["a"]["ts"] == datetime(2023, 11, 14, 22, 13, 20, 123000) and str(table["a"]["date"]) == "2023-11-14"
    records = {r["id"]: r for r in scored.to_record(df).collect()}
    assert records[None]["source"] is None and records[None]["sentiment"] == 0 and records[None]["scored_ts"] == 0
    assert set(records) == {None, "a", "b"} and records["b"]["title"] == "t"
    assert [r["id"] for r in scored.parse_feed_json(df).collect()] == ["b"]


def test_json_codec(spark):
    df = spark.createDataFrame([(b'{"id":"1","source":"s"}',), (b"",), (None,), (b"{oops",)], "value binary")
    assert [r["id"] for r in topic.decode_articles(df, schemas.RAW_SCHEMA).collect()] == ["1"]
    with pytest.raises(ValueError):
        topic.decode_articles(df, schemas.RAW_SCHEMA, codec="xml")


def test_topic_options(spark):
    opts = topic.TopicOptions("h:1", group_id="g", batch_size=9, max_offsets_per_trigger=5)
    assert opts.reader("t")["startingOffsets"] == "latest" and opts.reader("t")["kafka.group.id"] == "g"
    assert opts.writer("t") == {"kafka.bootstrap.servers": "h:1", "topic": "t", "kafka.acks": "all", "kafka.linger.ms": "5", "kafka.batch.size": "9"}
    df = spark.createDataFrame([("k", None)], "id string, v string")
    assert tuple(topic.keyed_messages(df).first()) == ("k", '{"id":"k","v":null}')


def _scored(spark, n, spread_ms):
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(0.5).cast("float").alias("sentiment"), (F.lit(1_704_067_200_000) + F.col("id") * spread_ms).alias("scored_ts"))
    none = F.array().cast("array<string>")
    return df.withColumns({"source": F.lit("s"), "url": F.lit("u"), "title": F.lit("t"), "tickers": none, "topics": none})


def test_archive_layout(spark, tmp_path):
    write_hourly_archive(_scored(spark, 1200, 6_000), str(tmp_path / "a"))
    files = glob.glob(str(tmp_path / "a/year=2024/month=01/day=01/hour=0?/*.parquet"))
    counts = [pq.ParquetFile(f).metadata for f in files]
    assert sum(m.num_rows for m in counts) == 1200 and max(m.num_rows for m in counts) <= 500
    assert counts[0].row_group(0).column(0).compression == "ZSTD"


def test_table_is_pruned_and_sorted(spark, tmp_path, plan):
    from newsloom.operators.analytics import ticker_sentiment

    path = str(tmp_path / "t")
    write_news_scored(_scored(spark, 400, 3_600_000), path)
    table = scored.read_news_scored(spark, path)
    assert table.count() == 400 and table.schema == schemas.NEWS_SCORED_SCHEMA
    text = plan(ticker_sentiment(table, 60, 3, F.lit(datetime(2024, 1, 5))))
    assert "PartitionFilters: [isnotnull(date" in text and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<ts:timestamp,tickers:array<string>,sentiment:float>" in text
    file = sorted(glob.glob(path + "/date=2024-01-03/*.parquet"))[0]
    stamps = pq.ParquetFile(file).read(columns=["ts"]).column("ts").to_pylist()
    assert stamps == sorted(stamps)
