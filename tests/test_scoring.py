"""Scorers and the scoring stage."""

import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.functions.sentiment import sentiment_from_logits
from newsloom.operators import scoring
from newsloom.operators.scoring import BatchScorer, LexiconScorer, OnnxScorer, score, zip_scores
from newsloom.settings import ScoreOptions

ROWS = [
    ("1", "Record profit", "gains and growth" + " filler" * 400 + " lawsuit", ["X"], ["zeta"]),
    ("2", "Lawsuit", "loss, fraud; inflation", [], []),
    ("3", None, None, None, None),
]
SCHEMA = "id string, title string, body string, tickers array<string>, topics array<string>"


@pytest.fixture(scope="module")
def enriched(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({"source": F.lit("s"), "url": F.lit("u")})


def test_lexicon(enriched):
    rows = {r["id"]: r for r in score(enriched, LexiconScorer(), as_of=7).collect()}
    e = np.exp
    assert rows["1"]["sentiment"] == pytest.approx((e(4) - 1) / (e(4) + e(1) + 1), abs=1e-6)
    assert rows["2"]["sentiment"] == pytest.approx((1 - e(4)) / (e(4) + e(1) + 1), abs=1e-6)
    assert rows["3"]["sentiment"] == 0 and rows["3"]["tickers"] == [] and rows["3"]["topics"] == []
    # The lawsuit lies past the part a model sees; the article's own topics stay.
    assert rows["1"]["topics"] == ["zeta"] and rows["2"]["topics"] == ["legal", "macro"]
    assert all(abs(r["sentiment"]) <= 1 and r["scored_ts"] == 7 for r in rows.values())


def test_rules_switch(enriched):
    rows = score(enriched, options=ScoreOptions(enable_rules=False)).filter("id = '2'").first()
    assert rows["topics"] == []


def test_word_edges(spark):
    df = spark.createDataFrame([("beat beats beaten upbeat é-beat BEAT",)], "t string")
    assert df.select(LexiconScorer().logits(F.col("t")).alias("l")).first()["l"] == [0.0, 1.0, 4.0]


def test_batch_scorer(enriched):
    def load():
        def model(texts):
            assert 0 < len(texts) <= 2
            return np.array([[0.0, 0.0, float(len(t) > 5)] for t in texts])

        return model

    rows = {r["id"]: r["sentiment"] for r in score(enriched, BatchScorer(load, batch_rows=2)).collect()}
    assert rows["1"] > 0 and rows["3"] == 0
    flipped = score(enriched, BatchScorer(load, ("positive", "neutral", "negative"))).filter("id = '1'").first()
    assert flipped["sentiment"] == pytest.approx(-rows["1"])


def _field(number, payload):
    """A length-delimited or varint protobuf field."""
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    data = payload.encode() if isinstance(payload, str) else payload
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _tiny_model():
    """An ONNX graph: logits = (number of tokens) x (0, 0, 1), from the attention mask."""

    def tensor_type(elem, *dims):
        shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
        return _field(1, _field(1, elem) + _field(2, shape))

    def value(name, elem, *dims):
        return _field(1, name) + _field(2, tensor_type(elem, *dims))

    def attr(name, number):
        return _field(5, _field(1, name) + _field(3, number) + _field(20, 2))

    weights = _field(1, 1) + _field(1, 3) + _field(2, 1) + _field(8, "w") + _field(9, struct.pack("<3f", 0, 0, 1))
    axes = _field(1, 1) + _field(2, 7) + _field(8, "axes") + _field(9, struct.pack("<q", 1))
    nodes = [
        _field(1, "attention_mask") + _field(2, "m") + _field(4, "Cast") + attr("to", 1),
        _field(1, "m") + _field(1, "axes") + _field(2, "n") + _field(4, "ReduceSum") + attr("keepdims", 1),
        _field(1, "n") + _field(1, "w") + _field(2, "logits") + _field(4, "MatMul"),
    ]
    graph = b"".join(_field(1, n) for n in nodes) + _field(2, "g") + _field(5, weights) + _field(5, axes)
    graph += _field(11, value("input_ids", 7, "b", "t")) + _field(11, value("attention_mask", 7, "b", "t"))
    graph += _field(12, value("logits", 1, "b", 3))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


def test_onnx_scorer(spark, enriched, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("onnxruntime")
    vocab = {"[UNK]": 0, "[PAD]": 1}
    tokenizer = tokenizers.Tokenizer(tokenizers.models.WordLevel(vocab, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "model.onnx").write_bytes(_tiny_model())
    scorer = OnnxScorer(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"), max_tokens=4)
    texts = spark.createDataFrame([(0, "a b"), (1, "a b c d e f"), (2, "")], "i int, t string").coalesce(1)
    rows = texts.select("i", scorer.logits(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in rows] == [[0, 0, 2], [0, 0, 4], [0, 0, 0]]


def test_zip_scores_stops_at_the_shortest(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [1.0, 2.0])], "x array<string>, y array<double>")
    zipped = df.select(zip_scores(F.col("x"), F.col("y")).alias("z")).first()["z"]
    assert [tuple(z) for z in zipped] == [("a", 1.0), ("b", 2.0)]


def test_default_scoring_stays_in_the_jvm(enriched, plan):
    text = plan(score(enriched, as_of=1))
    assert "EvalPython" not in text and "Exchange" not in text


def test_hashed_linear_scorer(spark):
    """Batches of 64, texts without words, an empty table, and labels in another order."""
    import hashlib

    rng = np.random.default_rng(4)
    weights = rng.normal(size=(97, 3))
    texts = ["Alpha beta alpha", "", None, "123 !", "été Zoo"] + [f"word{i} and more {i}" for i in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").repartition(3)
    scorer = scoring.HashedLinearScorer(spark, weights)
    found = {r["n"]: r["l"] for r in df.select("n", scorer.logits(F.col("t")).alias("l")).collect()}
    for n, text in enumerate(texts):
        words = [w.lower() for w in re.findall("[A-Za-z]+", text or "")]
        rows = [weights[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 97] for w in words]
        assert found[n] == pytest.approx(np.mean(rows, axis=0) if rows else np.zeros(3))
    assert df.limit(0).select(scorer.logits(F.col("t")).alias("l")).count() == 0
    turned = scoring.HashedLinearScorer(spark, weights[:, ::-1], ("positive", "neutral", "negative"))
    score = lambda s: [tuple(r) for r in df.orderBy("n").select(sentiment_from_logits(s.logits(F.col("t")), s.label_order).alias("s")).select("s.*").collect()]
    assert np.allclose(score(scorer), score(turned))
    with pytest.raises(ValueError):
        scoring.HashedLinearScorer(spark, weights, ("a", "b"))
