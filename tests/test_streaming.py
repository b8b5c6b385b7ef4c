"""Streams against the batch forms on the same input."""

import os
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.catalogue.tables import TICKER_ROWS
from newsloom.operators.dedup import dedup_ttl
from newsloom.operators.tickers import NoEntities
from newsloom.plans import articles
from newsloom.schemas import RAW_SCHEMA
from newsloom.settings import SinkOptions
from newsloom.sinks import commits
from newsloom.sources.tickers import tickers_from_rows
from newsloom.streaming import feeds, flows, metrics, state
from newsloom.streaming.running import run_until_idle

NOW_MS = 1_704_067_200_000


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def to_files(df, out, checkpoint):
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    run_until_idle(writer.trigger(availableNow=True).start(), 120)


def test_dedup_over_restarts(spark, folder):
    schema = "id string, n long"
    stream = lambda: state.dedup_stream(
        spark.readStream.schema(schema).parquet(folder("in")), "id", 172_800, order=("n",)
    )
    put(spark, [("a", 3), ("a", 1), ("b", 2)], schema, folder("in"))
    to_files(stream(), folder("out"), folder("cp"))
    put(spark, [("a", 0), ("c", 5)], schema, folder("in"))
    to_files(stream(), folder("out"), folder("cp"))
    assert sorted(map(tuple, spark.read.parquet(folder("out")).collect())) == [("a", 1), ("b", 2), ("c", 5)]


def test_expired_key_passes_again(spark, folder):
    schema = "id string, n long"
    put(spark, [("a", 1)], schema, folder("in"))
    for n in (2, 3):
        df = state.dedup_stream(spark.readStream.schema(schema).parquet(folder("in")), "id", 1)
        to_files(df, folder("out"), folder("cp"))
        time.sleep(1.2)
        put(spark, [("a", n)], schema, folder("in"))
    assert sorted(r["n"] for r in spark.read.parquet(folder("out")).collect()) == [1, 2]


HOUR = 3_600_000_000


def test_event_time_expiry_is_exact_over_batches(spark, folder):
    """Accepted in the first batch, suppressed in the second, accepted again in the third, at 48 hours to the microsecond."""
    schema = "id string, ts timestamp, n long"
    at = lambda us: datetime(2024, 1, 1) + timedelta(microseconds=us)
    parts = [
        [("a", at(0), 1), ("a", at(0), 0), ("b", at(HOUR), 2)],
        [("a", at(48 * HOUR - 1), 3), ("b", at(30 * HOUR), 4), ("c", at(31 * HOUR), 5)],
        [("a", at(48 * HOUR), 6), ("a", at(96 * HOUR - 1), 7), ("a", at(96 * HOUR), 8), ("b", at(49 * HOUR), 9), ("c", at(78 * HOUR), 10), (None, at(79 * HOUR), 11)],
    ]
    for part in parts:
        put(spark, part, schema, folder("in"))
        stream = spark.readStream.schema(schema).parquet(folder("in"))
        to_files(state.dedup_stream_event_time(stream, "id", "ts", 172_800, order=("n",), lateness="10 days"), folder("out"), folder("cp"))
    found = sorted((str(r["id"]), r["n"]) for r in spark.read.schema(schema).parquet(folder("out")).collect())
    assert found == [("None", 11), ("a", 0), ("a", 6), ("a", 8), ("b", 2), ("b", 9), ("c", 5)]


def test_keys_share_calls_and_states(spark, folder):
    """Very many keys, null among them, over three micro-batches: the batch form's rows, with a bounded number of states."""
    rows = spark.range(12_000).select(
        (F.col("id") * 7919 % 12_000).alias("n"),
        F.when(F.col("id") % 5000 != 0, (F.col("id") % 5000).cast("string")).alias("id"),
        F.timestamp_micros((F.col("id") * 7919 % 12_000) * 40_000_000 + F.lit(HOUR)).alias("ts"),
        F.when(F.col("id") % 3 != 0, F.lit(2**60) + F.col("id")).alias("large"),
    )
    whole = dedup_ttl(rows, "id", "ts", 172_800, tie=["n"])
    for step in range(3):
        rows.where(F.floor(F.col("n") / 4000) == step).write.mode("append").parquet(folder("in"))
        stream = spark.readStream.schema(rows.schema).parquet(folder("in"))
        kept = state.dedup_stream_event_time(stream, "id", "ts", 172_800, order=("n",))
        query = kept.writeStream.format("parquet").option("path", folder("out")).option("checkpointLocation", folder("cp")).trigger(availableNow=True).start()
        run_until_idle(query, 120)
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 5000
    out = spark.read.schema(rows.schema).parquet(folder("out"))
    assert out.count() == whole.count() > 5000 and out.exceptAll(whole).isEmpty()

    first = state.dedup_stream(spark.readStream.schema(rows.schema).parquet(folder("in")), "id", 172_800, order=("n",))
    to_files(first, folder("first"), folder("cp2"))
    earliest = rows.groupBy("id").agg(F.min_by(F.struct("n", "ts", "large"), "n").alias("v")).select("v.n", "id", "v.ts", "v.large")
    got = spark.read.schema(rows.schema).parquet(folder("first"))
    assert got.count() == 5000 and got.exceptAll(earliest).isEmpty()


def test_feed_list_is_bounded(spark, folder):
    schema = "tickers array<string>, scored_ts long, payload string"
    options = SinkOptions(feed_rows=3, feed_ttl_s=100)

    def lists(now=0):
        rows = feeds.read_feed(spark, folder("feed"), options, now).collect()
        return sorted((r["ticker"], r["rank"], r["scored_ts"], r["payload"]) for r in rows)

    assert lists() == []
    first = spark.createDataFrame([(["X", "Y", None], 1, "a"), (["X"], 2, "b"), (None, 3, "c"), ([], 4, "d"), (["X"], None, "e")], schema)
    second = spark.createDataFrame([(["X"], 5, "e"), (["X"], 4, "d")], schema)
    feeds.push_batch(first, folder("feed"), 0, options, now_ms=0)
    assert lists() == [("X", 1, 2, "b"), ("X", 2, 1, "a"), ("Y", 1, 1, "a")]
    for _ in range(2):  # a repeated batch changes nothing
        feeds.push_batch(second, folder("feed"), 1, options, now_ms=60_000)
        assert lists(99_999) == [("X", 1, 5, "e"), ("X", 2, 4, "d"), ("X", 3, 2, "b"), ("Y", 1, 1, "a")]
    # Y was pushed to 100 s ago; X's push renewed its whole list.
    assert {t for t, *_ in lists(100_000)} == {"X"} and lists(160_000) == []
    feeds.push_batch(spark.createDataFrame([(["Y"], 9, "z")], schema), folder("feed"), 2, options, now_ms=150_000)
    assert lists(150_000) == [("X", 1, 5, "e"), ("X", 2, 4, "d"), ("X", 3, 2, "b"), ("Y", 1, 9, "z")]
    assert len([p for p in (tmp_names(folder("feed"))) if p.startswith("version=")]) == 2


def tmp_names(path):
    return os.listdir(path)


def test_feed_trims_before_the_exchange(spark, folder, monkeypatch):
    """One ticker on all rows: each task sends at most the list's length."""
    rows = spark.range(0, 20_000, 1, 8).selectExpr("array('HOT') AS tickers", "id AS scored_ts", "cast(id AS string) AS payload")
    plans = []
    write = feeds._last_n
    monkeypatch.setattr(feeds, "_last_n", lambda df, n: plans.append(write(df, n)) or plans[-1])
    feeds.push_batch(rows, folder("feed"), 0, SinkOptions(feed_rows=5))
    assert [r["scored_ts"] for r in feeds.read_feed(spark, folder("feed")).orderBy("rank").collect()] == [19_999 - i for i in range(5)]
    text = plans[0]._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_committed_batches(spark, folder):
    """A batch that broke off or is repeated leaves its rows once; its files are few whatever the tasks."""
    root, rows = folder("t"), spark.range(0, 4_000, 1, 16).selectExpr("id", "id % 3 AS day")

    def write(place, parts=rows):
        parts.hint("rebalance", F.col("day")).write.partitionBy("day").parquet(place)

    def count():
        return sorted(map(tuple, spark.read.parquet(root).groupBy("day").count().collect()))

    everything = [(0, 1334), (1, 1333), (2, 1333)]
    moves = []
    move = commits.Folder.move

    def broken(self, source, target):
        moves.append(target)
        if len([m for m in moves if m.startswith("day=")]) == 2:
            raise OSError("lost")
        move(self, source, target)

    commits.Folder.move = broken
    try:
        with pytest.raises(OSError):
            commits.commit_batch(spark, root, "b-0", write)
    finally:
        commits.Folder.move = move
    assert commits.commit_batch(spark, root, "b-0", write) and count() == everything
    assert not commits.commit_batch(spark, root, "b-0", lambda place: 1 / 0) and count() == everything
    files = commits.Folder(spark, root).data_files("")
    assert len(files) == 3 and all("/b-0-" in f for f in files)
    assert commits.commit_batch(spark, root, "b-1", lambda place: write(place, rows.limit(0))) and count() == everything


def test_many_files_move_at_the_same_time(spark, folder, monkeypatch):
    """A commit of many files moves them in several runs at once; one that broke off leaves its rows once."""
    root, rows, movers = folder("t"), spark.range(0, 4_000, 1, 4).selectExpr("id", "id % 3 AS day"), set()
    move = commits.Folder.move

    def moved(self, source, target):
        if target.startswith("day="):
            movers.add(threading.get_ident())
            if target in lost:
                raise OSError("lost")
        move(self, source, target)

    def write(place):
        rows.write.option("maxRecordsPerFile", 10).partitionBy("day").parquet(place)

    monkeypatch.setattr(commits.Folder, "move", moved)
    lost = {"day=1/b-0-00200.parquet"}
    with pytest.raises(OSError):
        commits.commit_batch(spark, root, "b-0", write)
    lost.clear()
    assert commits.commit_batch(spark, root, "b-0", write)
    assert len(movers) > 1 and len(commits.Folder(spark, root).data_files("")) > 400
    back = spark.read.parquet(root)
    assert back.count() == 4_000 and back.select("id").distinct().count() == 4_000


def test_pages_as_a_stream(spark, folder):
    """An article meets its page whichever comes first, within the wait and not beyond it."""
    raw_schema, page_schema = RAW_SCHEMA, "url string, status int, html string, fetched_ts long"
    minute = 60_000
    raw = lambda name, at: (name, "s", f"http://h/{name}", name, "", at, at)
    page = lambda name, at, status=200: (f"http://h/{name}", status, f"page {name}", at)
    steps = [
        ([raw("early", NOW_MS), raw("lost", NOW_MS)], [page("later", NOW_MS), page("failed", NOW_MS, 404)]),
        ([raw("later", NOW_MS + 90 * minute), raw("failed", NOW_MS)], [page("early", NOW_MS + 60 * minute), page("lost", NOW_MS + 300 * minute)]),
        ([raw("none", NOW_MS + 600 * minute)], [page("x", NOW_MS + 600 * minute), ("http://h/none", 200, None, NOW_MS + 600 * minute)]),
    ]
    for raws, pages in steps:
        put(spark, raws, raw_schema, folder("raw"))
        put(spark, pages, page_schema, folder("pages"))
        joined = flows.attach_pages(spark.readStream.schema(raw_schema).parquet(folder("raw")), spark.readStream.schema(page_schema).parquet(folder("pages")))
        to_files(joined, folder("out"), folder("cp"))
    found = sorted((r["id"], r["html"]) for r in spark.read.parquet(folder("out")).collect())
    assert found == [("early", "page early"), ("later", "page later")]


def test_sliding_windows_by_panes(spark, folder):
    """An hour by a minute over two batches, with a late row, against counting each window's rows."""
    base = datetime(2024, 1, 1)
    seconds = [0, 30, 61, 3_599, 3_600, 5_000, 9_000]
    schema = "ts timestamp, tickers array<string>, sentiment float"
    rows = [(base + timedelta(seconds=s), ["T"], float(i)) for i, s in enumerate(seconds)]
    late = (base + timedelta(seconds=8_700), ["T"], 50.0)
    for part in (rows, [late, (base + timedelta(seconds=20_000), ["U"], 1.0), (base + timedelta(seconds=20_000), ["U"], None)]):
        put(spark, part, schema, folder("in"))
        means = metrics.live_ticker_sentiment(spark.readStream.schema(schema).parquet(folder("in")), min_count=1)
        to_files(means, folder("out"), folder("cp"))
    expected = {}
    for ts, _, value in [*rows, late]:
        for m in range(60):
            end = ts.replace(second=0) + timedelta(minutes=m + 1)
            expected.setdefault(end, []).append(value)
    closed = base + timedelta(seconds=20_000 - 600)
    found = {r["window_end"]: (r["avg_sent"], r["n"]) for r in spark.read.parquet(folder("out")).collect()}
    assert found == {e: (pytest.approx(sum(v) / len(v)), len(v)) for e, v in expected.items() if e <= closed}


def test_minute_counts_append_closed_windows(spark, folder):
    stamps = [(datetime(2024, 1, 1, 0, m, s),) for m in (0, 1, 30) for s in (1, 2)]
    put(spark, stamps, "ts timestamp", folder("in"))
    counts = metrics.live_minute_counts(spark.readStream.schema("ts timestamp").parquet(folder("in")))
    query = counts.writeStream.format("parquet").option("path", folder("out")).option("checkpointLocation", folder("cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    out = {r["minute"].minute: r["n"] for r in spark.read.schema(counts.schema).parquet(folder("out")).collect()}
    # The newest minute is still open under the watermark.
    assert out == {0: 2, 1: 2}


PAGE = "<title>$AAPL beats</title><article><p>{}</article>"


def test_stages_and_fan_out(spark, folder):
    raw = [(str(i), "s", f"http://h/{i}", f"t{i}", "", i, i) for i in range(4)]
    put(spark, raw, RAW_SCHEMA, folder("raw"))
    crawl = spark.createDataFrame([(f"http://h/{i}", 200 if i else 404, PAGE.format("profit " * 60)) for i in range(4)], "url string, status int, html string")
    dictionary = tickers_from_rows(spark, TICKER_ROWS)
    stream = flows.article_stream(spark.readStream.schema(RAW_SCHEMA).parquet(folder("raw")), crawl, dictionary, extractor=NoEntities(), as_of=NOW_MS)
    query = flows.start_fan_out(stream, folder("table"), folder("archive"), folder("cp"), trigger={"availableNow": True}, feed=folder("feed"))
    assert query.awaitTermination(180)
    feed = feeds.read_feed(spark, folder("feed")).collect()
    assert {r["ticker"] for r in feed} == {"AAPL"} and len(feed) == 3 and all('"tickers":["AAPL"]' in r["payload"] for r in feed)
    batch = articles.scored_articles(spark.createDataFrame(raw, RAW_SCHEMA), crawl, dictionary, extractor=NoEntities(), as_of=NOW_MS)
    expected = sorted((r["id"], r["tickers"], r["sentiment"], r["topics"]) for r in batch.collect())
    table = spark.read.parquet(folder("table"))
    assert sorted((r["id"], r["tickers"], r["sentiment"], r["topics"]) for r in table.collect()) == expected and len(expected) == 3
    archive = spark.read.parquet(folder("archive"))
    assert archive.count() == 3 and {r["year"] for r in archive.select("year").collect()} == {2024}


def test_raw_stream(spark, folder):
    xml = "<rss><channel><item><title>t</title><link>http://www.x.com/a/</link></item></channel></rss>"
    put(spark, [("s", xml), ("s", xml)], "source string, xml string", folder("in"))
    stream = flows.raw_stream(spark.readStream.schema("source string, xml string").parquet(folder("in")), as_of=5)
    to_files(stream, folder("out"), folder("cp"))
    rows = spark.read.parquet(folder("out")).collect()
    assert [(r["url"], r["published_ts"]) for r in rows] == [("http://x.com/a", 5)]


def test_late_rows_reach_their_own_hour(spark, folder):
    for ms in (NOW_MS + 7_200_000, NOW_MS):
        put(spark, [(f'{{"id":"{ms}","scored_ts":{ms}}}',), ("bad",)], "payload string", folder("in"))
        source = spark.readStream.schema("payload string").parquet(folder("in"))
        query = flows.archive_stream(source, folder("out"), folder("cp"), trigger={"availableNow": True})
        assert query.awaitTermination(120)
    hours = {(r["id"], r["hour"]) for r in spark.read.parquet(folder("out")).select("id", "hour").collect()}
    assert hours == {(str(NOW_MS), 0), (str(NOW_MS + 7_200_000), 2)}


def test_ingest_table(spark, folder):
    put(spark, [('{"id":"1","scored_ts":%d,"tickers":["X"]}' % NOW_MS,), ("{}",)], "payload string", folder("in"))
    query = flows.start_scored_ingest(spark.readStream.schema("payload string").parquet(folder("in")), folder("t"), folder("cp"), {"availableNow": True})
    assert query.awaitTermination(120)
    rows = {r["id"]: (str(r["date"]), r["tickers"]) for r in spark.read.parquet(folder("t")).collect()}
    assert rows == {"1": ("2024-01-01", ["X"]), "": ("1970-01-01", [])}


def test_arrival_stamp(spark):
    df = spark.createDataFrame([(NOW_MS,), (None,)], "scored_ts long")
    assert [r["ts"] for r in flows.stamp_arrival(df, NOW_MS).collect()] == [datetime(2024, 1, 1)] * 2


def test_label_counts_take_arrays_and_strings(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 30), "s", ["a", "b"])], "ts timestamp, source string, topics array<string>")
    assert metrics.live_label_counts(df, "topics", 60, "60 minutes").count() == 2
    assert metrics.live_label_counts(df, "source", 60, "60 minutes").select("label", F.hour("window_end").alias("h")).first()["h"] == 1
