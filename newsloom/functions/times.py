"""Time functions. The session time zone is expected to be UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, functions as F


def ms_to_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def ts_to_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def minute_floor(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def hour_bucket(ms: Column) -> Column:
    """UTC hour of an epoch-millisecond value."""
    return F.date_trunc("hour", F.timestamp_millis(ms))


def as_of_ts(as_of: datetime | Column | None) -> Column:
    """Reference time of a query: the wall clock unless the caller fixes one."""
    if as_of is None:
        return F.current_timestamp()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def as_of_ms(as_of: int | datetime | Column | None) -> Column:
    """Reference time in epoch milliseconds. A datetime without a zone is taken as UTC."""
    if as_of is None:
        return F.unix_millis(F.current_timestamp())
    if isinstance(as_of, datetime):
        aware = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
        return F.lit(round(aware.timestamp() * 1000)).cast("bigint")
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("bigint")
