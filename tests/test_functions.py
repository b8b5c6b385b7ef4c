"""Golden cases of the column functions."""

import math
from datetime import datetime, timezone

import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newsloom.functions import display, hints, ids, language, sentiment, strings, times, topics, urls


def apply(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


URLS = {
    "HTTPS://WWW.A.com/x/?utm_source=f&b=1#t": "https://a.com/x?b=1",
    "a.com/x#f": "a.com/x",
    "http://a.com/": "http://a.com/",
    "http://a.com/x//": "http://a.com/x/",
    "http://A.com?Q=1": "http://a.com?q=1",
    "http://a.com/p?a=1&&b=2": "http://a.com/p?a=1&&b=2",
    "http://a.com/p?&a=1": "http://a.com/p?a=1",
    "http://a.com/p?a=1&": "http://a.com/p?a=1",
    "http://a.com/p?UTM_x=1": "http://a.com/p?UTM_x=1",
    "http://a.com/p?fbclid=1": "http://a.com/p",
    "http://a.com/p?utm_a=1&&b=2": "http://a.com/p?b=2",
    "http://a.com/p?a=1&utm_b=2&c=3": "http://a.com/p?a=1&c=3",
    "http://a.com/p?&": "http://a.com/p",
    "": "",
}


def test_normalize_url(spark):
    assert apply(spark, urls.normalize_url, list(URLS)) == list(URLS.values())
    assert apply(spark, urls.normalize_url, [None]) == [None]


def _drop_tracking(query):
    """The parameter rule, walked part by part."""
    out, at = "", 0
    while at < len(query):
        end = query.find("&", at)
        part = query[at:] if end < 0 else query[at:end]
        if not part.startswith(("utm_", "fbclid=")):
            out = part if not out else f"{out}&{part}"
        if end < 0:
            break
        at = end + 1
    return out


def test_normalize_url_query_rule(spark):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet="ab&=", max_size=8) | st.sampled_from(["&utm_x=1", "&fbclid=2&", "utm_a&", "&&"]), max_size=5))
    def collect(parts):
        queries.add("".join(parts))

    queries: set[str] = set()
    collect()
    todo = sorted(queries)
    got = apply(spark, urls.normalize_url, [f"http://h/p?{q}" for q in todo])
    for query, url in zip(todo, got):
        kept = _drop_tracking(query)
        assert url == "http://h/p" + (f"?{kept}" if kept else ""), query


def test_normalize_url_idempotent(spark):
    once = apply(spark, urls.normalize_url, ["http://www.a.com/x/?b=1#t", "HTTP://B.com/Y?utm_a=1&c=2", "c/d#e"])
    assert apply(spark, urls.normalize_url, once) == once


def test_hosts_and_tokens(spark):
    assert apply(spark, urls.url_host, ["http://A.com:80/x", "a.com/x", "http://h"]) == ["a.com:80", "", "h"]
    assert apply(spark, lambda c: urls.url_host(c, schemeless=True), ["A.com/x", "http://B/x"]) == ["a.com", "b"]
    assert apply(spark, urls.path_tokens, ["http://h/Abc-de_fgh1?q=Word", "http://h", "x/yyy"]) == [["abc", "fgh1", "word"], [], ["yyy"]]


def test_stable_id(spark):
    assert apply(spark, ids.xxh64_hex, ["a", None]) == ["d24ec4f1a98c6e5b", None]
    assert apply(spark, lambda c: ids.stable_id(F.lit("src"), c), ["http://x.com/p"]) == ["602bec1d80ee53b2"]
    words = ["", "ü", "x" * 31, "y" * 32, "z" * 100]
    expected = [xxhash.xxh64_hexdigest(w.encode()) for w in words]
    assert apply(spark, ids.xxh64_hex, words) == expected
    assert apply(spark, ids._xxh64_hex_arrow, words) == expected
    with pytest.raises(ValueError):
        ids.stable_id(F.lit("a"), F.lit("b"), "crc")


def test_language(spark):
    texts = ["", "x" * 85 + "\x01" * 15, "x" * 86 + "\x01" * 14, "é" * 50, "a" * 6000 + "é" * 6000, "é" * 400 + "a" * 9000, None]
    tags = ["unknown", "unknown", "en", "unknown", "en", "unknown", "unknown"]
    # 400 two-byte letters are 800 of the first 5001 bytes: 0.84 plain.
    assert apply(spark, language.detect_language, texts) == tags


def test_language_shares(spark):
    texts = ["é" * k + "a" * 5000 for k in range(0, 3000, 271)]

    def share(text):
        head = text.encode()[:5001]
        return sum(32 <= b <= 126 or b in (9, 10, 13) for b in head) / len(head)

    got = apply(spark, language.ascii_share, texts)
    assert got == pytest.approx([share(t) for t in texts])


def test_min_body_counts_bytes(spark):
    df = spark.createDataFrame([("é" * 99 + "x",), ("é" * 100,)], "body string")
    assert language.filter_min_body(df, 200).count() == 1


def test_cashtags(spark):
    assert apply(spark, hints.hint_cashtags, ["$AAPL ($B) $MSFT $TOOLONG", "$A $B $C", "no", "$a", None]) == [
        ["$AAPL", "$B", "$MSFT"], ["$A", "$C"], [], [], []
    ]
    assert apply(spark, hints.extract_cashtags, ["$AAPL x$B $MSFTé $TOOLONG $B", "$A$B_ $C"]) == [["AAPL", "B"], ["A", "C"]]


def test_hints_sorted_and_distinct(spark):
    out = apply(spark, lambda c: hints.extract_hints(c, F.lit("$AA and $AA, ($BB)")), ["http://H.com/abc/abc?z=long1", "nohost/xyz"])
    assert out == [["$AA", "$BB", "host:h.com", "path:abc", "path:long1"], ["$AA", "$BB", "path:xyz"]]


def test_topics(spark):
    assert apply(spark, topics.topic_rules, ["q3 earnings beat; merger; gpu", "nothing", "price target cut"]) == [
        ["earnings", "m&a", "product"], [], ["rating/analyst"]
    ]
    df = spark.createDataFrame([(["b", "a"], ["a", "c"])], "x array<string>, y array<string>")
    assert df.select(topics.merge_topics(F.col("x"), F.col("y")).alias("m")).first()["m"] == ["a", "b", "c"]


def test_pipe(spark):
    assert apply(spark, strings.topics_split, ["a|b", "", "|a||", None]) == [["a", "b"], [], ["a"], []]
    assert apply(spark, strings.topics_pipe, [["a", "b"], []], "array<string>") == ["a|b", ""]


def test_texts(spark):
    row = spark.range(1).select(
        strings.model_text(F.lit("T"), F.lit("body"), 2).alias("m"),
        strings.model_text(F.lit(None), F.lit(None)).alias("n"),
        strings.entity_text(F.lit(" "), F.lit("ab\n"), 10).alias("e"),
    ).first()
    assert (row["m"], row["n"], row["e"]) == ("T\nbo", "\n", "ab")


def test_softmax(spark):
    rows = [[0.0, 0.0, 0.0], [1000.0, 0.0, 2.0], [-1.0, 0.5, 3.0]]
    soft = apply(spark, sentiment.softmax, rows, "array<double>")
    assert all(math.isclose(sum(p), 1.0) for p in soft)
    judged = apply(spark, sentiment.sentiment_from_logits, rows, "array<double>")
    assert judged[0]["sentiment"] == 0 and judged[0]["confidence"] == pytest.approx(1 / 3)
    assert all(j["sentiment"] == pytest.approx(p[2] - p[0]) and j["confidence"] == pytest.approx(max(p)) for j, p in zip(judged, soft))
    flipped = apply(spark, lambda c: sentiment.sentiment_from_logits(c, ("positive", "neutral", "negative")), rows, "array<double>")
    assert [f["sentiment"] for f in flipped] == pytest.approx([-j["sentiment"] for j in judged])


def test_bands_and_display(spark):
    values = [0.4, 0.39, -0.4, 0.0]
    assert apply(spark, sentiment.sentiment_band, values, "double") == ["positive", "neutral", "negative", "neutral"]
    assert apply(spark, sentiment.sentiment_sign, values, "double") == ["positive", "positive", "negative", "positive"]
    assert apply(spark, display.round2, [1234.5, -0.125], "double") == ["1234.50", "-0.13"]
    assert apply(spark, display.display_time, [0, None, 1_700_000_000_000], "bigint") == ["", "", "22:13:20"]
    row = spark.range(1).select(display.stat_label(F.lit(None), F.lit(None)).alias("l"), display.stat_count(F.lit(None)).alias("n")).first()
    assert (row["l"], row["n"]) == ("n/a", 0)


def test_times(spark):
    moment = datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    row = spark.range(1).select(
        times.as_of_ms(moment).alias("a"),
        times.as_of_ms(moment.replace(tzinfo=None)).alias("b"),
        times.as_of_ms(7).alias("c"),
        times.hour_bucket(times.as_of_ms(moment)).cast("string").alias("h"),
        times.minute_floor(times.ms_to_ts(times.as_of_ms(moment))).cast("string").alias("m"),
        times.ts_to_ms(times.ms_to_ts(F.lit(1234))).alias("t"),
    ).first()
    assert row["a"] == row["b"] == 1_704_164_645_000 and row["c"] == 7
    assert (row["h"], row["m"], row["t"]) == ("2024-01-02 03:00:00", "2024-01-02 03:04:00", 1234)
