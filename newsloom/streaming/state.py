"""Keyed state: first-seen filters.

Keys are dealt into buckets by their hash, and a bucket is one Python call per micro-batch: its state
holds the accepted keys and their times as two arrays, its rows come as Arrow batches. So the calls
are bounded by buckets times micro-batches, however many keys there are. Expiry is in processing time
or in event time: each key has the time it counts from. Expired keys leave when their bucket is next
called, at the latest when the newest of them has expired, since a timeout fires then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegralType, StringType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Groups of keys that share a state; fixed for a checkpoint.
BUCKETS = 4096

_STATE = "keys array<string>, accepted array<bigint>"
# Stands for a missing time: before all others, and expired.
_NO_TIME = -(1 << 62)


def use_rocksdb(spark: SparkSession) -> None:
    """Keep state in RocksDB, off the heap, with incremental checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _bucketed(df: DataFrame, key: str, order: list[str], buckets: int) -> tuple[DataFrame, list[str], list[Column]]:
    """Rows with `_key` and `_bucket`, the columns to sort by for `order`, and the original columns.

    Pandas would make floats of integers with nulls among them, so these travel as 0 beside a flag.
    """
    text = F.col(key) if isinstance(df.schema[key].dataType, StringType) else F.to_json(F.struct(key))
    rows = df.withColumn("_key", text).withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    whole = {f.name: f"_null{i}" for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, IntegralType)}
    rows = rows.withColumns({flag: F.col(c).isNull() for c, flag in whole.items()})
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in whole})
    by = [part for c in order for part in ([whole[c], c] if c in whole else [c])]
    back = [F.when(~F.col(whole[c]), F.col(c)).alias(c) if c in whole else F.col(c) for c in df.columns]
    return rows, by, back


def _held(state: GroupState) -> dict[str | None, int]:
    return dict(zip(*state.get)) if state.exists else {}


def _keep(state: GroupState, held: dict[str | None, int], before: dict[str | None, int]) -> None:
    if not held:
        if state.exists:
            state.remove()
    elif held != before:
        state.update((list(held), list(held.values())))


def dedup_stream(df: DataFrame, key: str = "id", ttl_s: int = 172_800, order: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """First row per key, again allowed `ttl_s` of processing time after an accepted row; rows in
    between do not extend it.

    One exchange by bucket. Of several rows of a key in one micro-batch the first in `order` counts;
    they are looked at batch by batch, and of a key no more than one is held.
    """
    use_rocksdb(df.sparkSession)
    ttl_ms = ttl_s * 1000
    rows, by, back = _bucketed(df, key, list(order), buckets)

    def first_seen(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, before = state.getCurrentProcessingTimeMs(), _held(state)
        held = {k: at for k, at in before.items() if now - at < ttl_ms}
        first = None
        for batch in batches:
            if held:
                batch = batch[[k not in held for k in batch["_key"].tolist()]]
            batch = batch if first is None else pd.concat([first, batch])
            batch = batch.sort_values(by, kind="stable") if by else batch
            first = batch.drop_duplicates("_key")
        if first is not None:
            held.update(dict.fromkeys(first["_key"].tolist(), now))
        _keep(state, held, before)
        if held:
            state.setTimeoutDuration(max(held.values()) + ttl_ms - now)
        if first is not None and len(first):
            yield first.reset_index(drop=True)

    seen = rows.groupBy("_bucket").applyInPandasWithState(
        first_seen,
        outputStructType=rows.schema,
        stateStructType=_STATE,
        outputMode="append",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout,
    )
    return seen.select(*back)


def dedup_stream_event_time(
    df: DataFrame, key: str = "id", ts: str = "ts", ttl_s: int = 172_800, order: tuple[str, ...] = (), lateness: str = "0 seconds", buckets: int = BUCKETS
) -> DataFrame:
    """Rows whose key was not accepted within `ttl_s` of event time before them; exact, like the batch form.

    The time runs from the accepted row. A micro-batch's rows of a bucket are walked by time, then by
    `order`; a row that arrives after a later one of its key was accepted is suppressed, and rows
    later than `lateness` behind the newest one may be. A key is dropped when the watermark has
    passed its expiry.
    """
    use_rocksdb(df.sparkSession)
    ttl_us = ttl_s * 1_000_000
    rows, by, back = _bucketed(df.withWatermark(ts, lateness), key, list(order), buckets)
    rows = rows.withColumn("_untimed", F.col(ts).isNull())
    rows = rows.withColumn("_at", F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(_NO_TIME)))
    by = ["_untimed", "_at", *by]

    def walk(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = _held(state)
        held, parts = dict(before), []

        def passes(key: str | None, at: int) -> bool:
            last = held.get(key)
            return last is None or at - last >= ttl_us

        for batch in batches:
            if held:
                # What the state suppresses is not held.
                batch = batch[[passes(k, at) for k, at in zip(batch["_key"].tolist(), batch["_at"].tolist())]]
            parts.append(batch)
        walked = pd.concat(parts).sort_values(by, kind="stable")
        kept = []
        for i, (k, at) in enumerate(zip(walked["_key"].tolist(), walked["_at"].tolist())):
            if passes(k, at):
                held[k] = at
                kept.append(i)
        passed = state.getCurrentWatermarkMs()
        held = {k: at for k, at in held.items() if at + ttl_us > passed * 1000}
        _keep(state, held, before)
        if held:
            state.setTimeoutTimestamp(-(-(max(held.values()) + ttl_us) // 1000))
        if kept:
            yield walked.iloc[kept].reset_index(drop=True)

    seen = rows.groupBy("_bucket").applyInPandasWithState(
        walk,
        outputStructType=rows.schema,
        stateStructType=_STATE,
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return seen.select(*back)
