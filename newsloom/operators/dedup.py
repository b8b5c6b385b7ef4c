"""First-seen filters with expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from newsloom.settings import discard, written

# Largest number of rows of one key that are folded as one sorted array.
FOLD_LIMIT = 10_000
# Times of one key that a window of the pointer walk holds, about.
CELL_ROWS = 1_000_000


def _ticks(df: DataFrame, ts: str) -> tuple[Column, int]:
    """The time column as a long, and how many of its units make a second."""
    if isinstance(df.schema[ts].dataType, LongType):
        return F.col(ts), 1_000
    return F.unix_micros(F.col(ts).cast("timestamp")), 1_000_000


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. A minimum aggregates before the exchange, so a key of any
    weight sends one row per task."""
    rest = [c for c in df.columns if c not in key and c not in order]
    if not [*order, *rest]:
        return df.distinct()
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*key, *[F.col("_first")[c].alias(c) for c in (*order, *rest)])


def _fold(df: DataFrame, key: Sequence[str], order: Sequence[str], ttl: int) -> DataFrame:
    """Walk the time-ordered rows of each key, keeping a row when it is `ttl` past the kept one."""
    rest = [c for c in df.columns if c not in key and c not in order]
    row = F.struct(*order, *rest)
    row_type = df.select(row.alias("r")).schema["r"].dataType.simpleString()
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast(f"array<{row_type}>").alias("kept"))
    state = f"struct<last:bigint,kept:array<{row_type}>>"

    def step(acc: Column, r: Column) -> Column:
        taken = F.struct(r["_t"].alias("last"), F.concat(acc["kept"], F.array(r)).alias("kept"))
        return F.when(acc["last"].isNull() | (r["_t"] - acc["last"] >= ttl), taken.cast(state)).otherwise(acc)

    walked = df.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    kept = walked.select(*key, F.explode(F.aggregate("_rows", start.cast(state), step)["kept"]).alias("_r"))
    return kept.select(*key, *[F.col("_r")[c].alias(c) for c in (*order, *rest)])


def _next_times(times: DataFrame, ttl: int, cell_rows: int) -> DataFrame:
    """`_k, _t, _next`: for each distinct time of a key its first time at least `ttl` later, if there is one.

    Time is cut into cells, narrow enough to hold about `cell_rows` times of a key. A time is
    looked up in the cell it points into; past that cell's last time the answer is the first time
    of the key's next cell that holds one. So no window is longer than a cell, or than a key's cells.
    """
    densest = times.groupBy("_k", F.floor(F.col("_t") / F.lit(ttl))).count().agg(F.max("count")).first()[0] or 1
    width = max(1, ttl // -(-densest // cell_rows))
    cell = F.floor(F.col("_at") / F.lit(width)).cast("bigint").alias("_cell")
    none = F.lit(None).cast("bigint")
    stored = times.select("_k", F.col("_t").alias("_at"), F.col("_t").alias("_stored"), none.alias("_t"))
    asked = times.select("_k", (F.col("_t") + ttl).alias("_at"), none.alias("_stored"), "_t")
    both = stored.unionByName(asked).select("*", cell)
    # From the latest time back, a stored time before one that asks for the same time.
    back = Window.partitionBy("_k", "_cell").orderBy(F.desc("_at"), F.desc_nulls_last("_stored"))
    inside = both.withColumn("_inside", F.last("_stored", ignorenulls=True).over(back)).where(F.col("_t").isNotNull())
    later = Window.partitionBy("_k").orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = both.groupBy("_k", "_cell").agg(F.min("_stored").alias("_first"))
    after = cells.select("_k", "_cell", F.last("_first", ignorenulls=True).over(later).alias("_after"))
    found = inside.select("_k", "_cell", "_t", "_inside").join(after, ["_k", "_cell"])
    return found.select("_k", "_t", F.coalesce("_inside", "_after").alias("_next")).where(F.col("_next").isNotNull())


def kept_times(times: DataFrame, ttl: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """`_k, _t`: the times a walk of each key keeps, of its distinct times `_k, _t`.

    Every time points to the one that would be kept after it. The first time of each key is kept;
    in each round the kept ones' pointers add as many again, and the pointers are doubled, so the
    rounds grow with the logarithm of the times a key keeps. Joins meet on key and time, which are
    distinct, so no key is heavy; each round is a written table, and the one before it is deleted.
    """
    pointers = written(_next_times(times, ttl, cell_rows), "dedup-pointers")
    kept = written(times.groupBy("_k").agg(F.min("_t").alias("_t")), "dedup-kept")
    while True:
        added = written(kept.join(pointers, ["_k", "_t"]).select("_k", F.col("_next").alias("_t")), "dedup-added")
        if added.isEmpty():
            return kept
        joined = written(kept.unionByName(added), "dedup-kept")
        second = pointers.select("_k", F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        doubled = written(pointers.join(second, ["_k", "_next"]).select("_k", "_t", F.col("_far").alias("_next")), "dedup-pointers")
        for old in (kept, pointers, added):
            discard(old)
        kept, pointers = joined, doubled


def _pointer_walk(df: DataFrame, key: Sequence[str], order: Sequence[str], ttl: int) -> DataFrame:
    """The same result for keys too heavy for one array: the kept times by pointer doubling, then the first row of each."""
    named = F.struct(*key).alias("_k")
    times = written(df.select(named, "_t").distinct(), "dedup-times")
    kept = kept_times(times, ttl)
    rows = df.withColumn("_k", named).join(kept, ["_k", "_t"], "left_semi").drop("_k")
    return first_per_key(rows, [*key, "_t"], [c for c in order if c != "_t"])


def dedup_ttl(
    df: DataFrame,
    key: str | Sequence[str],
    ts: str,
    ttl_s: int,
    tie: Sequence[str] = (),
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Keep a row when its key has not been kept within the last `ttl_s` seconds.

    The time runs from the kept row; suppressed rows do not extend it. Rows of equal time are
    ordered by `tie`, then by the remaining columns. `ts` is a timestamp or epoch milliseconds.

    One aggregate over key and time decides the plan. If no key spans a whole TTL the answer is
    the first row per key. Otherwise keys are folded as sorted arrays, except keys with more than
    `fold_limit` rows: these are walked by pointer doubling, or, where they do not span a TTL, are
    again the first row per key. The input is read for that aggregate and
    again for the result, so pass costly plans through `settings.written` first.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ticks, unit = _ticks(df, ts)
    ttl, columns = ttl_s * unit, df.columns
    timed = df.withColumn("_t", ticks).filter(F.col("_t").isNotNull())
    order = ["_t", *tie]

    per_key = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (F.max("_t") - F.min("_t")).alias("_span"))
    big = per_key.filter(F.col("_n") > fold_limit).select(*keys, (F.col("_span") >= ttl).alias("_long"))
    facts = per_key.agg(
        F.max("_span").alias("span"),
        F.count_if(F.col("_n") > fold_limit).alias("big"),
        F.count_if((F.col("_n") > fold_limit) & (F.col("_span") >= ttl)).alias("long"),
    ).first()

    if facts["span"] is None or facts["span"] < ttl:
        return first_per_key(timed, keys, order).select(*columns)
    if not facts["big"]:
        return _fold(timed, keys, order, ttl).select(*columns)

    # The big keys are written, so all branches see the same set and it is found once.
    big_keys = written(big, "dedup-keys")

    def only(side: DataFrame, how: str) -> DataFrame:
        return timed.join(side, [timed[k].eqNullSafe(side[k]) for k in keys], how)

    out = _fold(only(big_keys, "left_anti"), keys, order, ttl).select(*columns)
    out = out.unionByName(first_per_key(only(big_keys.filter(~F.col("_long")), "left_semi"), keys, order).select(*columns))
    if facts["long"]:
        out = out.unionByName(_pointer_walk(only(big_keys.filter("_long"), "left_semi"), keys, order, ttl).select(*columns))
    return out


def new_articles(batch: DataFrame, history: DataFrame, ttl_s: int, key: str = "id", ts: str = "ts") -> DataFrame:
    """Rows of a load whose key was not kept in the history within `ttl_s` seconds before them.

    History rows later than a load row do not count, nor does history outside the load's own time
    range and one `ttl_s` before it; that bound is a literal filter on `ts`, which reaches the scan.
    Time is cut into slices one `ttl_s` long: of a key's history in a slice, the first row decides
    for the load rows of that slice, and the last row for those of the next. Both aggregate before
    the exchange, so a key of any weight is two rows per slice.
    """
    ticks, unit = _ticks(batch, ts)
    past_ticks, past_unit = _ticks(history, ts)
    if unit != past_unit:
        raise ValueError("both sides need the same kind of time column")
    ttl = ttl_s * unit
    span = batch.agg(F.min(ticks).alias("first"), F.max(ticks).alias("last")).first()
    if span["first"] is None:
        return batch
    kind = history.schema[ts].dataType

    def literal(at: int) -> Column:
        return F.lit(at) if isinstance(kind, LongType) else F.timestamp_micros(F.lit(at)).cast(kind)

    recent = history.filter((F.col(ts) > literal(span["first"] - ttl)) & (F.col(ts) <= literal(span["last"])))
    sliced = recent.select(F.col(key).alias("_key"), past_ticks.alias("_at")).withColumn("_slice", F.floor(F.col("_at") / F.lit(ttl)).cast("long"))
    ends = sliced.groupBy("_key", "_slice").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    decides = F.array(F.struct("_slice", F.col("_first").alias("_at")), F.struct((F.col("_slice") + 1).alias("_slice"), F.col("_last").alias("_at")))
    kept = ends.select("_key", F.explode(decides).alias("_e")).select("_key", "_e.*")
    timed = batch.withColumn("_t", ticks)
    gap = timed["_t"] - kept["_at"]
    same_slice = F.floor(timed["_t"] / F.lit(ttl)).cast("long") == kept["_slice"]
    seen = (timed[key] == kept["_key"]) & same_slice & (gap >= 0) & (gap < ttl)
    return timed.join(kept, seen, "left_anti").drop("_t")
