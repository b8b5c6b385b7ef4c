"""Keyword topics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from newsloom.functions.strings import sorted_set

# Topic and the substrings that signal it.
TOPIC_KEYWORDS = {
    "guidance": ["guidance", "outlook", "forecast"],
    "earnings": ["earnings", "q1", "q2", "q3", "q4", "fiscal", "full-year", "eps", "revenue", "beat", "miss"],
    "m&a": ["acquire", "acquisition", "merger", "m&a", "takeover"],
    "legal": ["lawsuit", "litigation", "settlement", "sues", "sued", "investigation"],
    "rating/analyst": ["downgrade", "upgrade", "initiates coverage", "price target"],
    "macro": ["macro", "inflation", "cpi", "jobs report", "fed", "interest rates", "treasury"],
    "product": ["product", "launches", "introduces", "unveils", "chip", "ai model", "device", "phone", "gpu"],
}


def topic_rules(lowered: Column) -> Column:
    """Sorted topics of an already lower-cased text.

    `contains` is a plain byte search inside generated code; an alternation regex over the same
    keywords would be slower. Pass title and body joined by a line break, which no keyword holds.
    """
    hits = [
        F.when(reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(k)) for k in words]), F.lit(topic)).otherwise("")
        for topic, words in sorted(TOPIC_KEYWORDS.items())
    ]
    return F.array_remove(F.array(*hits), "")


def merge_topics(rule_topics: Column, model_topics: Column) -> Column:
    return sorted_set(rule_topics, model_topics)
