"""Cashtags and the hints derived from an article's URL and text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from newsloom.functions.strings import empty_strings, sorted_set
from newsloom.functions.urls import after_host, url_host

# A hint cashtag stands between delimiters; a body cashtag only ends at a word break.
HINT_CASHTAG = r"(?:\A|[\s(\[])(\$[A-Z]{1,5})(?:\z|[\s)\],.!?;:])"
BODY_CASHTAG = r"\$([A-Z]{1,5})(?![\p{L}\p{N}_])"


def hint_cashtags(text: Column) -> Column:
    """Delimited cashtags with their dollar sign."""
    # A search that starts with a literal is several times faster, and most texts end there.
    maybe = F.rlike(text, F.lit(r"\$[A-Z]"))
    return F.when(maybe, F.regexp_extract_all(text, F.lit(HINT_CASHTAG), F.lit(1))).otherwise(empty_strings())


def extract_cashtags(text: Column) -> Column:
    """Distinct symbols written as cashtags anywhere in the text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(BODY_CASHTAG), F.lit(1)))


def hint_host(url: Column) -> Column:
    """`host:<h>`, or null for a URL without one."""
    host = url_host(url)
    return F.when(host != "", F.concat(F.lit("host:"), host))


def hint_path_tokens(url: Column) -> Column:
    # Every run gets the prefix first, so the length test is one more pattern and not a lambda.
    marked = F.regexp_replace(after_host(url), "([a-z0-9]+)", "path:$1")
    return F.regexp_extract_all(marked, F.lit(r"path:[a-z0-9]{3,}"), F.lit(0))


def extract_hints(url: Column, text: Column) -> Column:
    host = F.when(url_host(url) != "", F.array(hint_host(url))).otherwise(empty_strings())
    return sorted_set(hint_cashtags(text), host, hint_path_tokens(url))
