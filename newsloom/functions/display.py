"""Display helpers for result rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round2(value: Column) -> Column:
    """Two decimals, always shown, no digit grouping."""
    return F.format_string("%.2f", value.cast("double"))


def display_time(ms: Column, fmt: str = "HH:mm:ss") -> Column:
    """Formatted UTC time, empty for a missing or zero value."""
    return F.when(ms.isNotNull() & (ms != 0), F.date_format(F.timestamp_millis(ms), fmt)).otherwise("")


def stat_label(source: Column, topic: Column) -> Column:
    return F.coalesce(source, topic, F.lit("n/a"))


def stat_count(n: Column) -> Column:
    return F.coalesce(n, F.lit(0))
