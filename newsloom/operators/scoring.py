"""Sentiment scoring of enriched articles through a pluggable scorer."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from newsloom.functions.sentiment import LABEL_ORDER, sentiment_from_logits
from newsloom.functions.strings import empty_strings, model_text, topics_pipe, topics_split
from newsloom.functions.times import as_of_ms
from newsloom.functions.topics import merge_topics, topic_rules
from newsloom.settings import ScoreOptions

# Word lists of the default scorer.
POSITIVE_WORDS = ["advances", "beat", "beats", "gain", "gains", "growth", "launches", "profit", "record", "strong", "surge", "unveils", "upgrade", "wins"]
NEGATIVE_WORDS = ["decline", "downgrade", "drop", "falls", "fraud", "inflation", "investigation", "lawsuit", "litigation", "loss", "miss", "recall", "sued", "weak"]


class Scorer(Protocol):
    """Gives the class logits (negative, neutral, positive) of a text column."""

    label_order: Sequence[str]

    def logits(self, text: Column) -> Column: ...


class LexiconScorer:
    """Counts positive and negative words: logits are (negative count, 1, positive count)."""

    label_order = LABEL_ORDER

    def __init__(self, positive: Sequence[str] = POSITIVE_WORDS, negative: Sequence[str] = NEGATIVE_WORDS):
        self.positive, self.negative = list(positive), list(negative)

    def logits(self, text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))

        def count(found: Column, wanted: list[str]) -> Column:
            return F.size(F.filter(found, lambda w: w.isin(wanted))).cast("double")

        # Bound as a lambda's variable, the word list is made once for both counts.
        both = F.transform(F.array(words), lambda ws: F.array(count(ws, self.negative), F.lit(1.0), count(ws, self.positive)))
        return F.get(both, F.lit(0))


class BatchScorer:
    """A scorer around a Python model.

    `load` runs once per task and returns a function from a list of texts to an n×3 array of
    logits; texts reach it in Arrow batches, at most `batch_rows` at a time.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], np.ndarray]], label_order: Sequence[str] = LABEL_ORDER, batch_rows: int = 64):
        self.load, self.label_order, self.batch_rows = load, label_order, batch_rows

    def logits(self, text: Column) -> Column:
        load, size = self.load, self.batch_rows

        @F.pandas_udf(ArrayType(DoubleType()))
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for texts in batches:
                rows: list[np.ndarray] = []
                for at in range(0, len(texts), size):
                    rows.extend(np.asarray(model(texts.iloc[at : at + size].tolist()), dtype="float64"))
                yield pd.Series(rows, dtype="object")

        return run(text)


class HashedLinearScorer(BatchScorer):
    """A linear model over hashed words: logits are the mean weights of a text's words.

    `weights` has a row per bucket and a column per label; it is shared with the workers once. A
    word's bucket is the head of its MD5, so every engine can find it. Texts without a word get
    logits of 0.
    """

    def __init__(self, spark: SparkSession, weights: np.ndarray, label_order: Sequence[str] = LABEL_ORDER, batch_rows: int = 64):
        if weights.ndim != 2 or weights.shape[1] != len(label_order):
            raise ValueError("a row of weights needs a number per label")
        shared = spark.sparkContext.broadcast(np.ascontiguousarray(weights, dtype="float64"))
        known_words = 200_000

        def load() -> Callable[[list[str]], np.ndarray]:
            weights, known = shared.value, {}
            word = re.compile("[A-Za-z]+")

            def bucket(found: str) -> int:
                number = known.get(found)
                if number is None:
                    if len(known) >= known_words:
                        known.clear()
                    number = known[found] = int(hashlib.md5(found.lower().encode()).hexdigest()[:7], 16) % len(weights)
                return number

            def model(texts: list[str]) -> np.ndarray:
                words = [word.findall(t or "") for t in texts]
                counts = np.array([len(w) for w in words], np.int64)
                buckets = np.fromiter((bucket(w) for found in words for w in found), np.int64, counts.sum())
                sums = np.zeros((len(texts), weights.shape[1]))
                np.add.at(sums, np.repeat(np.arange(len(texts)), counts), weights[buckets])
                return sums / np.maximum(counts, 1)[:, None]

            return model

        super().__init__(load, label_order, batch_rows)


class OnnxScorer(BatchScorer):
    """A sequence-classification model in ONNX form with a `tokenizer.json`.

    Both files must be readable on the workers. Inputs are the first two of the model: token ids
    and attention mask, padded to the longest text of a batch and cut at `max_tokens`.
    """

    def __init__(self, model_path: str, tokenizer_path: str, max_tokens: int = 256, label_order: Sequence[str] = LABEL_ORDER, batch_rows: int = 64):
        def load() -> Callable[[list[str]], np.ndarray]:
            import onnxruntime
            from tokenizers import Tokenizer

            session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
            ids_input, mask_input = session.get_inputs()[:2]
            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.enable_truncation(max_length=max_tokens)
            tokenizer.enable_padding()

            def as_input(rows: list[list[int]], spec) -> np.ndarray:
                return np.asarray(rows, dtype="int64" if "int64" in spec.type else "int32")

            def model(texts: list[str]) -> np.ndarray:
                coded = tokenizer.encode_batch(texts)
                feed = {
                    ids_input.name: as_input([c.ids for c in coded], ids_input),
                    mask_input.name: as_input([c.attention_mask for c in coded], mask_input),
                }
                return session.run(None, feed)[0]

            return model

        super().__init__(load, label_order, batch_rows)


def zip_scores(items: Column, *scores: Column) -> Column:
    """Items with their parallel score arrays by position; the shortest array decides the length."""
    n = F.least(*[F.size(c) for c in (items, *scores)])
    named = [F.slice(c, F.lit(1), n).alias(f"s{i}") for i, c in enumerate((items, *scores))]
    return F.arrays_zip(*named)


def score(
    enriched: DataFrame,
    scorer: Scorer | None = None,
    options: ScoreOptions = ScoreOptions(),
    as_of=None,
) -> DataFrame:
    """Scored articles: `id, source, url, title, tickers, sentiment, confidence, topics, scored_ts`.

    The model text is cut before it reaches the scorer. Rule topics of that text, in their
    pipe-joined form, are merged with the article's own topics.
    """
    scorer = scorer if scorer is not None else LexiconScorer()
    text = model_text(F.col("title"), F.col("body"), options.model_chars)
    texts = enriched.withColumn("_text", text)
    judged = texts.withColumn("_logits", scorer.logits(F.col("_text")))
    if options.enable_rules:
        judged = judged.withColumn("_low", F.lower("_text")).withColumn("_pipe", topics_pipe(topic_rules(F.col("_low"))))
    else:
        judged = judged.withColumn("_pipe", F.lit(""))
    return judged.withColumn("_s", sentiment_from_logits(F.col("_logits"), scorer.label_order)).select(
        "id",
        "source",
        "url",
        "title",
        F.coalesce("tickers", empty_strings()).alias("tickers"),
        F.col("_s.sentiment").cast("float").alias("sentiment"),
        F.col("_s.confidence").cast("float").alias("confidence"),
        merge_topics(F.col("topics"), topics_split(F.col("_pipe"))).alias("topics"),
        as_of_ms(as_of).alias("scored_ts"),
    )
