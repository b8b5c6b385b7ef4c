"""String primitives shared by the other modules."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, functions as F

# Separates title from body wherever both are searched as one text.
TITLE_BREAK = "\n"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(col, ascii_uppercase, ascii_lowercase)


def trim_space(col: Column) -> Column:
    """Strip space, tab, newline, vertical tab, form feed and carriage return from both ends."""
    return F.regexp_replace(col, r"\A[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z", "")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else empty_strings()


def sorted_set(*arrays: Column) -> Column:
    """Sorted distinct union of string arrays; missing arrays count as empty."""
    parts = [F.coalesce(a, empty_strings()) for a in arrays]
    return F.sort_array(F.array_distinct(F.concat(*parts)))


def topics_pipe(topics: Column) -> Column:
    return F.array_join(topics, "|")


def topics_split(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[|]"), "")


def model_text(title: Column, body: Column, n_chars: int = 2000) -> Column:
    """Title, line break and the first `n_chars` characters of the body."""
    return F.concat(
        F.coalesce(title, F.lit("")),
        F.lit(TITLE_BREAK),
        F.substring(F.coalesce(body, F.lit("")), 1, n_chars),
    )


def entity_text(title: Column, body: Column, n_chars: int = 3000) -> Column:
    """The trimmed text handed to an entity extractor."""
    return trim_space(model_text(title, body, n_chars))
