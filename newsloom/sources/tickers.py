"""The ticker dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsloom.functions.strings import empty_strings
from newsloom.schemas import TICKER_CSV_SCHEMA


def _split_aliases(text):
    return F.filter(
        F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda a: F.trim(a)), lambda a: a != ""
    )


def tickers_from_frame(rows: DataFrame) -> DataFrame:
    """The dictionary of rows with `symbol, name, aliases` (parted by semicolons) and `ord`."""
    name = F.trim(F.coalesce("name", F.lit("")))
    aliases = _split_aliases(F.col("aliases"))
    entries = rows.select(
        F.upper(F.trim("symbol")).alias("symbol"),
        name.alias("name"),
        F.when(name != "", F.array_distinct(F.concat(F.array(name), aliases)))
        .otherwise(F.coalesce(aliases, empty_strings()))
        .alias("aliases"),
        F.col("ord").cast("int").alias("ord"),
    )
    # A repeated symbol keeps its first place and its last entry.
    return entries.groupBy("symbol").agg(
        F.max_by("name", "ord").alias("name"), F.max_by("aliases", "ord").alias("aliases"), F.min("ord").alias("ord")
    )


def load_tickers(spark: SparkSession, path: str, repair: bool = False) -> DataFrame:
    """`symbol, name, aliases, ord` from a CSV with a header; `ord` is the order in the file.

    A name holding an unquoted comma is cut there and its rest is read as the aliases, as plain
    CSV rules have it. With `repair` a surplus column is folded back: the overflow of the name is
    joined to it and the last column holds the aliases.
    """
    schema = TICKER_CSV_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ")
    columns = "symbol string, name string, aliases string, extra string" if repair else schema
    # One file is one split read in order, so a running id is the file order.
    rows = (
        spark.read.schema(columns)
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", True)
        .csv(path)
        .withColumn("ord", F.monotonically_increasing_id())
    )
    if repair:
        cut = F.col("extra").isNotNull()
        rows = rows.select(
            "symbol",
            F.when(cut, F.concat_ws(", ", "name", F.trim("aliases"))).otherwise(F.col("name")).alias("name"),
            F.when(cut, F.col("extra")).otherwise(F.col("aliases")).alias("aliases"),
            "ord",
        )
    return tickers_from_frame(rows)


def tickers_from_rows(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """The same dictionary from (symbol, name, aliases) tuples in order."""
    data = [(i, *row) for i, row in enumerate(rows)]
    return tickers_from_frame(spark.createDataFrame(data, "ord int, symbol string, name string, aliases string"))


def alias_index(tickers: DataFrame) -> DataFrame:
    """One row per alias of each symbol: `alias, symbol, ord, pos`, in dictionary order."""
    return tickers.select("symbol", "ord", F.posexplode("aliases").alias("pos", "alias"))


def alias_owner(tickers: DataFrame) -> DataFrame:
    """The one symbol an alias stands for: the first in dictionary order."""
    return alias_index(tickers).groupBy("alias").agg(F.min_by("symbol", "ord").alias("symbol"))
