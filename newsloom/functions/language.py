"""Language tag and the row filters that use it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the tag: bytes looked at, and the share of them that must be plain ASCII.
SAMPLE_BYTES = 5001
ASCII_SHARE = 0.85


def ascii_share(text: Column) -> Column:
    """Share of printable ASCII, tab, newline and carriage return among the first 5001 bytes."""


    def others(sample: Column) -> Column:
        return F.regexp_replace(sample, r"[\x20-\x7E\t\n\r]+", "")

    # 5001 bytes never need more than 5001 characters, so long bodies are cut before encoding.
    head = F.substring(F.encode(F.substring(text, 1, SAMPLE_BYTES), "UTF-8"), 1, SAMPLE_BYTES)
    odd_of_head = F.length(others(F.decode(head, "ISO-8859-1")))
    n_bytes = F.octet_length(text)
    return F.when(n_bytes <= SAMPLE_BYTES, (n_bytes - F.octet_length(others(text))) / n_bytes).otherwise(
        (SAMPLE_BYTES - odd_of_head) / F.lit(SAMPLE_BYTES)
    )


def detect_language(text: Column) -> Column:
    return F.when((text != "") & (ascii_share(text) > ASCII_SHARE), "en").otherwise("unknown")


def filter_english(df: DataFrame, require: bool = True) -> DataFrame:
    return df.filter(F.col("language") == "en") if require else df


def filter_min_body(df: DataFrame, min_bytes: int = 200) -> DataFrame:
    return df.filter(F.octet_length("body") >= min_bytes)
