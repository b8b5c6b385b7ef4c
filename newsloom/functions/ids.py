"""Stable article ids."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _xxh64_hex_arrow(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else xxhash.xxh64_hexdigest(k.encode("utf-8")))


def _xxh64_hex_jvm(key: Column) -> Column:
    # The SQL function xxhash64() is this expression with its seed fixed at 42.
    jvm = SparkSession.getActiveSession()._jvm
    bridge = jvm.org.apache.spark.sql.classic.ExpressionUtils
    children = jvm.PythonUtils.toSeq([bridge.expression(key._jc)])
    hashed = bridge.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(children, 0))
    return F.lpad(F.lower(F.hex(type(key)(hashed))), 16, "0")


def xxh64_hex(key: Column) -> Column:
    """XXH64 with seed 0 as 16 lower-case hex digits, inside the JVM where a JVM is at hand."""
    if hasattr(key, "_jc"):
        return F.when(key.isNotNull(), _xxh64_hex_jvm(key))
    return _xxh64_hex_arrow(key)


def stable_id(source: Column, url: Column, algo: str = "xxh64") -> Column:
    """Id of an article: a hash of `source|url`, so one URL from two sources is two articles."""
    key = F.concat(source, F.lit("|"), url)
    if algo == "xxh64":
        return xxh64_hex(key)
    if algo == "md5":
        return F.md5(key)
    raise ValueError(f"unknown id algorithm: {algo}")
