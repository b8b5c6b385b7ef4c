"""Running queries: stage chains, table ingest and archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.language import filter_english, filter_min_body
from newsloom.functions.times import as_of_ms
from newsloom.operators.scoring import Scorer, score
from newsloom.operators.tickers import EntityExtractor
from newsloom.plans.articles import clean, enrich, to_clean, to_raw
from newsloom.settings import CleanOptions, IngestOptions, ResolveOptions, ScoreOptions, SinkOptions
from newsloom.sinks.commits import commit_batch
from newsloom.sinks.tables import write_hourly_archive, write_news_scored
from newsloom.sources.crawl import successful_fetches
from newsloom.sources.feeds import feed_items
from newsloom.sources.scored import parse_scored_json, to_record, to_scored_json
from newsloom.streaming.feeds import push_batch
from newsloom.streaming.state import dedup_stream


def raw_stream(feeds: DataFrame, options: IngestOptions = IngestOptions(), as_of=None, algo: str = "xxh64") -> DataFrame:
    """Feed documents to new raw articles."""
    return dedup_stream(to_raw(feed_items(feeds, as_of=as_of), as_of, algo), "id", options.dedup_ttl_s, order=("title",))


def score_stream(
    enriched: DataFrame, scorer: Scorer | None = None, options: ScoreOptions = ScoreOptions(), as_of=None
) -> DataFrame:
    """Scored articles, micro-batch by micro-batch; a `BatchScorer` cuts each into its own batches."""
    return score(enriched, scorer, options, as_of)


def attach_pages(
    raw: DataFrame,
    pages: DataFrame,
    wait: str = "2 hours",
    lateness: str = "10 minutes",
    raw_ts: str = "ingested_ts",
    page_ts: str = "fetched_ts",
) -> DataFrame:
    """Raw articles with the `html` fetched for their URL within `wait` before or after, both sides streams.

    Times are epoch milliseconds. A side's rows stay in the state until the watermark, `lateness`
    behind the slower side's newest row, has passed all the times they may meet.
    """
    seen = raw.withColumn("_seen", F.timestamp_millis(raw_ts)).withWatermark("_seen", lateness)
    fetched = successful_fetches(pages).filter(F.col("html").isNotNull())
    fetched = fetched.select(F.col("url").alias("_url"), "html", F.timestamp_millis(page_ts).alias("_fetched")).withWatermark("_fetched", lateness)
    near = F.expr(f"url = _url AND _fetched BETWEEN _seen - INTERVAL {wait} AND _seen + INTERVAL {wait}")
    return seen.join(fetched, near).drop("_url", "_seen", "_fetched")


def article_stream(
    raw: DataFrame,
    crawl: DataFrame,
    tickers: DataFrame,
    scorer: Scorer | None = None,
    extractor: EntityExtractor | None = None,
    as_of=None,
    clean_options: CleanOptions = CleanOptions(),
    resolve_options: ResolveOptions = ResolveOptions(),
    score_options: ScoreOptions = ScoreOptions(),
    wait: str = "2 hours",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Raw articles to scored ones in one streaming plan.

    `crawl` is a stream of fetched pages (`url, status, html, fetched_ts`), or a static table, which
    then is read once per micro-batch. The page join is the only step that is not row-local.
    """
    if crawl.isStreaming:
        articles = to_clean(attach_pages(raw, crawl, wait, lateness))
        cleaned = filter_min_body(filter_english(articles, clean_options.require_english), clean_options.min_body_bytes)
    else:
        cleaned = clean(raw, crawl, clean_options, parse_first=False)
    return score_stream(enrich(cleaned, tickers, extractor, resolve_options), scorer, score_options, as_of)


def _started(stream: DataFrame, write, checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _add_to_table(rows: DataFrame, path: str, batch: int) -> None:
    commit_batch(rows.sparkSession, path, f"batch-{batch:09d}", lambda folder: write_news_scored(rows, folder))


def _add_to_archive(rows: DataFrame, root: str, batch: int, most: int) -> None:
    commit_batch(rows.sparkSession, root, f"batch-{batch:09d}", lambda folder: write_hourly_archive(rows, folder, most))


def start_scored_ingest(payloads: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Scored JSON messages into the date-partitioned table, each micro-batch once.

    A micro-batch is rebalanced by day, so it leaves a file per day it touches, or several for a
    day with very many rows, whatever the number of tasks.
    """
    rows = parse_scored_json(payloads)
    return _started(rows, lambda part, batch: _add_to_table(part, path, batch), checkpoint, trigger or {"processingTime": "10 seconds"})


def archive_stream(
    payloads: DataFrame, root: str, checkpoint: str, options: SinkOptions = SinkOptions(), trigger: dict | None = None
) -> StreamingQuery:
    """Scored JSON messages into the hourly archive, each micro-batch once. A late row goes to its
    own, older hour. A micro-batch leaves a file per hour and `archive_rows_per_file` rows."""

    def write(part: DataFrame, batch: int) -> None:
        _add_to_archive(part, root, batch, options.archive_rows_per_file)

    return _started(to_record(payloads), write, checkpoint, trigger or {"processingTime": f"{options.archive_idle_s} seconds"})


def start_fan_out(
    scored: DataFrame,
    table: str,
    archive: str,
    checkpoint: str,
    options: SinkOptions = SinkOptions(),
    trigger: dict | None = None,
    feed: str | None = None,
) -> StreamingQuery:
    """Scored articles into table, archive and (where a folder is given) the ticker feeds, from one
    computation of each micro-batch. A repeated batch leaves the same rows in all of them."""

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            _add_to_table(rows, table, batch)
            _add_to_archive(rows, archive, batch, options.archive_rows_per_file)
            if feed is not None:
                push_batch(to_scored_json(rows, keep=("tickers", "scored_ts")), feed, batch, options)
        finally:
            rows.unpersist()

    return _started(scored, write, checkpoint, trigger or {"processingTime": "10 seconds"})


def stamp_arrival(scored: DataFrame, as_of=None) -> DataFrame:
    """Scored rows with `ts`, for the streaming metrics."""
    return scored.withColumn("ts", F.timestamp_millis(F.coalesce("scored_ts", as_of_ms(as_of))))
