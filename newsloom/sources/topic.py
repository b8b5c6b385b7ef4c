"""Message topics and message payloads.

Topics need Spark's Kafka connector and protobuf payloads its protobuf package; both are named
here by their public format and function names only, and nothing else in the library needs them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class TopicOptions:
    bootstrap_servers: str = "kafka:9092"
    group_id: str | None = None
    starting_offsets: str = "latest"
    acks: str = "all"
    linger_ms: int = 5
    batch_size: int | None = None
    max_offsets_per_trigger: int | None = None
    extra: dict[str, str] = field(default_factory=dict)

    def reader(self, topic: str) -> dict[str, str]:
        opts = {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "subscribe": topic,
            "startingOffsets": self.starting_offsets,
            "failOnDataLoss": "false",
        }
        if self.group_id:
            opts["kafka.group.id"] = self.group_id
        if self.max_offsets_per_trigger:
            opts["maxOffsetsPerTrigger"] = str(self.max_offsets_per_trigger)
        return opts | self.extra

    def writer(self, topic: str) -> dict[str, str]:
        opts = {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "topic": topic,
            "kafka.acks": self.acks,
            "kafka.linger.ms": str(self.linger_ms),
        }
        if self.batch_size:
            opts["kafka.batch.size"] = str(self.batch_size)
        return opts | self.extra


def read_topic(spark: SparkSession, options: TopicOptions, topic: str) -> DataFrame:
    """Streaming `key STRING, value BINARY` of a topic, from the latest offset by default."""
    stream = spark.readStream.format("kafka").options(**options.reader(topic)).load()
    return stream.select(F.col("key").cast("string").alias("key"), "value")


def keyed_messages(df: DataFrame, key: str = "id", value: str | None = None) -> DataFrame:
    """`key, value` messages: the row as JSON, or a ready-made payload column."""
    payload = F.col(value) if value else F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.col(key).cast("string").alias("key"), payload.alias("value"))


def write_topic(df: DataFrame, options: TopicOptions, topic: str, checkpoint: str, key: str = "id", value: str | None = None) -> DataStreamWriter:
    """A prepared stream writer of keyed messages; call `start()` on it."""
    return (
        keyed_messages(df, key, value)
        .writeStream.format("kafka")
        .options(**options.writer(topic))
        .option("checkpointLocation", checkpoint)
    )


def decode_articles(df: DataFrame, schema: StructType, value: str = "value", codec: str = "json", message: str | None = None, descriptor: str | None = None) -> DataFrame:
    """Articles from payloads; empty and undecodable payloads are skipped."""
    payload = F.col(value)
    filled = df.filter(payload.isNotNull() & (F.octet_length(payload) > 0))
    if codec == "json":
        with_bad = StructType(list(schema.fields)).add("_bad", "string")
        opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
        parsed = filled.select(F.from_json(payload.cast("string"), with_bad, opts).alias("m"))
        return parsed.filter(F.col("m").isNotNull() & F.col("m._bad").isNull()).select(
            *[F.col(f"m.{n}").alias(n) for n in schema.names]
        )
    if codec == "protobuf":
        from pyspark.sql.protobuf.functions import from_protobuf

        decoded = from_protobuf(payload, message, descriptor, options={"mode": "PERMISSIVE"})
        return filled.select(decoded.alias("m")).filter("m is not null").select("m.*")
    raise ValueError(f"unknown codec: {codec}")
