"""From class logits to sentiment, and the bands sentiment is shown in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Label order of the logits, and the band limit.
LABEL_ORDER = ("negative", "neutral", "positive")
BAND_LIMIT = 0.4


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum so that large logits do not overflow."""
    # The finish step of an aggregate sees its result once, so maximum and total are not redone per element.
    def scaled(top: Column) -> Column:
        powers = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
        return F.aggregate(
            powers, F.lit(0.0), lambda acc, x: acc + x, lambda total: F.transform(powers, lambda p: p / total)
        )

    return F.get(F.transform(F.array(F.array_max(logits).cast("double")), scaled), F.lit(0))


def sentiment_from_logits(logits: Column, label_order: Sequence[str] = LABEL_ORDER) -> Column:
    """Struct of `sentiment` = P(positive) - P(negative) and `confidence` = the largest P."""
    order = list(label_order)
    terms = [F.exp(logits[i].cast("double") - F.array_max(logits).cast("double")) for i in range(len(order))]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.struct(
        ((terms[order.index("positive")] - terms[order.index("negative")]) / total).alias("sentiment"),
        (F.greatest(*terms) / total).alias("confidence"),
    )


def sentiment_band(sentiment: Column) -> Column:
    return (
        F.when(sentiment >= BAND_LIMIT, "positive").when(sentiment <= -BAND_LIMIT, "negative").otherwise("neutral")
    )


def sentiment_sign(sentiment: Column) -> Column:
    return F.when(sentiment >= 0, "positive").otherwise("negative")
