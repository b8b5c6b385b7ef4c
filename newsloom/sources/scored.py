"""Scored messages as JSON, and the analytics table made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from newsloom.functions.strings import empty_strings
from newsloom.schemas import NEWS_SCORED_SCHEMA, SCORED_SCHEMA

# Missing fields become the default of their type.
_DEFAULTS = {"id": "", "source": "", "url": "", "title": "", "sentiment": 0.0, "scored_ts": 0}

# Field by field: a field of the wrong type is a missing field, not a lost record.
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
_WITH_BAD = StructType(list(SCORED_SCHEMA.fields)).add("_bad", "string")


def to_scored_json(df: DataFrame, column: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """Keyed compact JSON of the scored message fields, with further columns to keep beside it."""
    body = F.struct(*[F.col(n).cast(SCORED_SCHEMA[n].dataType).alias(n) for n in SCORED_SCHEMA.names])
    return df.select("id", *keep, F.to_json(body, {"ignoreNullFields": "false"}).alias(column))


def _field(name: str, parsed: str = "m") -> Column:
    return F.col(f"{parsed}.{name}")


def _is_object(payload: Column) -> Column:
    """True for text that is one JSON object, whatever its fields hold."""
    return F.json_object_keys(payload).isNotNull()


def parse_scored_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Payload strings as rows of the analytics table; missing fields take their type's default.
    Text that is not a JSON object is skipped."""
    parsed = df.filter(_is_object(F.col(payload))).select(F.from_json(F.col(payload), _WITH_BAD, _OPTIONS).alias("m"))
    ts = F.timestamp_millis(F.coalesce(_field("scored_ts"), F.lit(0)))
    return parsed.select(
        ts.alias("ts"),
        *[F.coalesce(_field(n), F.lit(_DEFAULTS[n])).alias(n) for n in ("id", "source", "url", "title")],
        F.coalesce(_field("tickers"), empty_strings()).alias("tickers"),
        F.coalesce(_field("sentiment"), F.lit(0.0)).cast("float").alias("sentiment"),
        F.coalesce(_field("topics"), empty_strings()).alias("topics"),
        F.to_date(ts).alias("date"),
    )


def to_record(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Archive records: strings stay null when missing, lists and numbers get defaults, text that
    is not a JSON object is skipped."""
    parsed = df.filter(_is_object(F.col(payload))).select(F.from_json(F.col(payload), _WITH_BAD, _OPTIONS).alias("m"))
    return parsed.select(
        *[_field(n).alias(n) for n in ("id", "source", "url", "title")],
        F.coalesce(_field("tickers"), empty_strings()).alias("tickers"),
        F.coalesce(_field("sentiment"), F.lit(0.0)).cast("float").alias("sentiment"),
        F.coalesce(_field("topics"), empty_strings()).alias("topics"),
        F.coalesce(_field("scored_ts"), F.lit(0)).cast("bigint").alias("scored_ts"),
    )


def parse_feed_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Scored rows for the ticker feeds: rows whose `tickers` is not a list drop out."""
    parsed = df.filter(_is_object(F.col(payload))).select(
        F.col(payload), F.from_json(F.col(payload), _WITH_BAD, _OPTIONS).alias("m")
    )
    return parsed.filter(_field("tickers").isNotNull()).select(
        payload, *[_field(n).alias(n) for n in SCORED_SCHEMA.names]
    )


def read_news_scored(spark: SparkSession, path: str) -> DataFrame:
    """The analytics table, with its fixed schema."""
    return spark.read.schema(NEWS_SCORED_SCHEMA).parquet(path)
