"""Quality classifier: a factorisation machine.

Features of a text are hashed words (share of each bucket, unit length), structure statistics cut
into bins, and metadata (the character count column, where given). Their pairwise interactions
have rank `rank` and are summed in linear time: half of (sum of v x) squared minus sum of (v x)
squared, per factor.

Defined results: a null text counts as empty; an empty text has no word features and gets the
score of its structure bins; null metadata is a bin of its own; repeated rows get equal scores;
an empty table gives an empty result; without usable labels every score is 0.5. Columns other than
the named ones are ignored, so they cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import arrow_texts, parts_of

STATS = 13
BINS = 16


@dataclass(frozen=True)
class FMOptions:
    """`sample_rows` bounds the labelled rows that training sees; everything else is a hyperparameter.

    A small sample is passed over more often, until `least_steps` batches were seen.
    """

    buckets: int = 1 << 15
    rank: int = 8
    epochs: int = 10
    least_steps: int = 900
    batch: int = 64
    rate: float = 0.08
    l2: float = 2e-4
    sample_rows: int = 6000
    seed: int = 7


@dataclass(frozen=True)
class FMModel:
    options: FMOptions
    bias: float
    linear: np.ndarray
    factors: np.ndarray


# Byte classes: 0 other, 1 lower letter, 2 upper letter, 3 digit, 4 blank, 5 sentence mark, 6 symbol, 7 line end.
_CLASS = np.zeros(256, np.uint8)
for _byte in range(128):
    _char = chr(_byte)
    _CLASS[_byte] = (
        7 if _char == "\n" else 4 if _char.isspace() else 1 if _char.islower() else 2 if _char.isupper() else 3 if _char.isdigit() else 5 if _char in ",.;:'\"?-()" else 6 if _char.isprintable() else 0
    )


class Featurizer:
    """Turns a text into sorted feature numbers and their values."""

    def __init__(self, options: FMOptions):
        self.buckets = options.buckets
        self.size = options.buckets + (STATS + 1) * BINS
        self._known: dict[bytes, int] = {}

    def _ids(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        if len(known) > 200_000:
            known.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh32_intdigest(word) % self.buckets
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def __call__(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        data = text.encode("utf-8", "surrogatepass")
        ids = self._ids(data.lower().split())
        found, counts = np.unique(ids, return_counts=True)
        values = counts / max(1.0, np.sqrt((counts.astype(float) ** 2).sum()))
        classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8) / max(1, len(data))
        lines = data.split(b"\n")
        n = max(1, len(ids))
        stats = np.array([
            np.log1p(len(data)) / 14,
            min(1.0, len(data) / n / 24),
            classes[1],
            min(1.0, classes[2] * 2),
            min(1.0, classes[3] * 4),
            classes[4],
            min(1.0, classes[5] * 5),
            min(1.0, classes[6] * 3),
            min(1.0, classes[7] * 40),
            len(found) / n,
            (ids[1:] == ids[:-1]).mean() if len(ids) > 1 else 0.0,
            counts.max() / n if len(counts) else 0.0,
            1 - len(set(lines)) / len(lines),
        ])
        bins = np.minimum(BINS - 1, (stats * BINS).astype(np.int64)) + self.buckets + np.arange(STATS) * BINS
        meta = 0 if n_chars is None else 1 + min(BINS - 2, int(np.log1p(max(0, n_chars))))
        index = np.concatenate([found, bins, [self.buckets + STATS * BINS + meta]])
        return index, np.concatenate([values, np.full(STATS + 1, 0.3)])


def raw_score(model: FMModel, index: np.ndarray, values: np.ndarray) -> float:
    part = model.factors[index] * values[:, None]
    whole = part.sum(0)
    return model.bias + float(model.linear[index] @ values) + 0.5 * float(whole @ whole - (part * part).sum())


def probability(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(rows: list[tuple[float, np.ndarray, np.ndarray]], options: FMOptions) -> FMModel:
    """Logistic loss by AdaGrad over mini-batches; rows are (label, feature numbers, values)."""
    rng = np.random.default_rng(options.seed)
    size = Featurizer(options).size
    linear, factors, bias = np.zeros(size), rng.normal(0, 0.05, (size, options.rank)), 0.0
    if not rows:
        return FMModel(options, 0.0, linear, np.zeros_like(factors))
    seen_l, seen_f, seen_b = np.full(size, 1e-2), np.full((size, options.rank), 1e-2), 1e-2
    labels = np.array([r[0] for r in rows])
    epochs = max(options.epochs, -(-options.least_steps * options.batch // len(rows)))
    for _ in range(min(epochs, options.least_steps)):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), options.batch):
            chosen = order[start : start + options.batch]
            index = np.concatenate([rows[i][1] for i in chosen])
            values = np.concatenate([rows[i][2] for i in chosen])
            sizes = np.array([len(rows[i][1]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            part = factors[index] * values[:, None]
            sums = np.add.reduceat(part, starts)
            raw = bias + np.add.reduceat(linear[index] * values, starts) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((part**2).sum(1), starts))
            slope = (probability(raw) - labels[chosen]) / len(chosen)
            each = np.repeat(slope, sizes) * values
            used, back = np.unique(index, return_inverse=True)
            grad_l = np.bincount(back, each, len(used)) + options.l2 * linear[used]
            pull = each[:, None] * (np.repeat(sums, sizes, axis=0) - part)
            by = np.argsort(back, kind="stable")
            cuts = np.searchsorted(back[by], np.arange(len(used)))
            grad_f = np.add.reduceat(pull[by], cuts) + options.l2 * factors[used]
            seen_l[used] += grad_l**2
            seen_f[used] += grad_f**2
            linear[used] -= options.rate * grad_l / np.sqrt(seen_l[used])
            factors[used] -= options.rate * grad_f / np.sqrt(seen_f[used])
            seen_b += slope.sum() ** 2
            bias -= options.rate * slope.sum() / np.sqrt(seen_b)
    return FMModel(options, bias, linear, factors)


def give_back() -> None:
    """Arrow keeps the memory of tables that are gone; the driver needs no such table again."""
    pa.default_memory_pool().release_unused()


def train(docs: DataFrame, labels: DataFrame, options: FMOptions = FMOptions(), label: str = "quality") -> FMModel:
    """Learns from at most `options.sample_rows` labelled documents, chosen by a hash of their id.

    Where an id is labelled more than once, the label that most of its rows have counts (1 on a tie).
    Only the bounded sample of ids is broadcast, and only feature vectors come to the driver.
    """
    sample = (
        labels.select("doc_id", F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.when(F.avg("label") >= 0.5, 1.0).otherwise(0.0).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(options.sample_rows)
    )
    count = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), count.alias("n_chars")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text", "n_chars")

    def featurize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(options)
        for batch in batches:
            made = [make(t, n) for t, n in zip(arrow_texts(batch.column(2)), batch.column(3).to_pylist())]
            out = [batch.column(0).cast(pa.string()), batch.column(1), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "label", "index", "value"])

    found = rows.mapInArrow(featurize, "id string, label double, index array<bigint>, value array<double>").toArrow().sort_by("id")
    index, value = found["index"].combine_chunks(), found["value"].combine_chunks()
    model = fit([(y, index[i].values.to_numpy(), value[i].values.to_numpy()) for i, y in enumerate(found["label"].to_pylist())], options)
    del found, index, value
    give_back()
    return model


def score(docs: DataFrame, model: FMModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from `threshold` on) of every row. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    count = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        make = Featurizer(fm.options)
        for batch in batches:
            raw = np.array([raw_score(fm, *make(t, n)) for t, n in zip(arrow_texts(batch.column(1)), batch.column(2).to_pylist())])
            scores = probability(raw)
            out = [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), count.alias("n_chars")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: FMModel, threshold: float = 0.3) -> DataFrame:
    """The documents that the model accepts, with all their columns, in one pass and without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    text, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = shared.value
        make = Featurizer(fm.options)
        for batch in parts_of(batches, text, 4 << 20):
            counts = batch.column(count).to_pylist() if count is not None else [None] * batch.num_rows
            raw = np.array([raw_score(fm, *make(t, n)) for t, n in zip(arrow_texts(batch.column(text)), counts)])
            yield batch.filter(pa.array(probability(raw) >= threshold))

    return docs.mapInArrow(run, docs.schema)
