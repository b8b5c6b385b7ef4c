"""Explicit schemas of every stage; nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _F = T.StringType(), T.LongType(), T.FloatType()
_STRINGS = T.ArrayType(T.StringType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


RAW_SCHEMA = _schema(id=_S, source=_S, url=_S, title=_S, body=_S, published_ts=_L, ingested_ts=_L)

CLEAN_SCHEMA = _schema(
    id=_S, source=_S, url=_S, title=_S, body=_S, published_ts=_L, hints=_STRINGS, language=_S
)

ENRICHED_SCHEMA = _schema(
    id=_S, title=_S, body=_S, published_ts=_L, tickers=_STRINGS, entities=_STRINGS,
    topics=_STRINGS, source=_S, url=_S,
)

# The published scored message; `confidence` travels next to it but is not part of it.
SCORED_SCHEMA = _schema(
    id=_S, source=_S, url=_S, title=_S, tickers=_STRINGS, sentiment=_F, topics=_STRINGS, scored_ts=_L
)

NEWS_SCORED_SCHEMA = _schema(
    ts=T.TimestampType(), id=_S, source=_S, url=_S, title=_S, tickers=_STRINGS, sentiment=_F,
    topics=_STRINGS, date=T.DateType(),
)

TICKER_CSV_SCHEMA = _schema(symbol=_S, name=_S, aliases=_S)

TICKERS_SCHEMA = _schema(symbol=_S, name=_S, aliases=_STRINGS, ord=T.IntegerType())

FEEDS_SCHEMA = _schema(source=_S, url=_S)

CRAWL_SCHEMA = _schema(url=_S, status=T.IntegerType(), html=_S)

ROBOTS_SCHEMA = _schema(host=_S, status=T.IntegerType(), body=_S)
