"""Options of Kafka sources and sinks, for batch and streaming readers and writers.

Spark's Kafka connector is a separate jar; without it, reading fails with Spark's own error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.codec import decode, encode, parsed
from tidewheel.operators.compaction import latest
from tidewheel.schemas import DELTA, MANIFEST, MANIFEST_KEY

Write = Callable[[DataFrame], None]


def brokers(text: str) -> list[str]:
    """Comma-separated brokers, trimmed, without empty ones."""
    return [b.strip() for b in text.split(",") if b.strip()]


def source_options(bootstrap: str, topic: str, group: str | None = None, max_offsets: int | None = None) -> dict[str, str]:
    """Committed records only, from the start; fetching in large pieces."""
    if not brokers(bootstrap):
        raise ValueError("no broker is given")
    out = {
        "kafka.bootstrap.servers": ",".join(brokers(bootstrap)), "subscribe": topic, "startingOffsets": "earliest", "kafka.isolation.level": "read_committed",
        "kafka.fetch.min.bytes": str(2 * 1024 * 1024), "failOnDataLoss": "true",
    }
    if group:
        out["kafka.group.id"] = group
    if max_offsets:
        out["maxOffsetsPerTrigger"] = str(max_offsets)
    return out


def sink_options(bootstrap: str, topic: str) -> dict[str, str]:
    """Acknowledged by all replicas, batched and compressed. Spark writes at least once; outputs are keyed and cumulative, so repeats do no harm."""
    return {"kafka.bootstrap.servers": ",".join(brokers(bootstrap)), "topic": topic, "kafka.acks": "all", "kafka.linger.ms": "5", "kafka.compression.type": "lz4", "kafka.enable.idempotence": "true"}


def read_stream(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.readStream.format("kafka").options(**options).load()


def read_batch(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """All partitions up to their present ends."""
    return spark.read.format("kafka").options(**{k: v for k, v in options.items() if k != "maxOffsetsPerTrigger"}).option("endingOffsets", "latest").load()


def writer(options: dict[str, str]) -> Write:
    return lambda df: df.write.format("kafka").options(**options).save()


def manifest_latest(records: DataFrame, position: str = "offset") -> DataFrame:
    """The manifest of the last record with its key, over all partitions; no row without one, or where it is malformed."""
    return decode(_last_manifest(records, position).select("value"), MANIFEST)


def _last_manifest(records: DataFrame, position: str) -> DataFrame:
    mine = records.where(F.col("key").cast("string") == MANIFEST_KEY).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), position)
    return latest(mine, ["key"], position)


def read_manifest(records: DataFrame, position: str = "offset") -> dict:
    """The manifest of the last record with its key; raises without one, and on a malformed one."""
    row = parsed(_last_manifest(records, position), MANIFEST).select("_bad", "_record").first()
    if row is None:
        raise LookupError("the topic has no manifest")
    if row._bad:
        raise ValueError("the last manifest of the topic is malformed")
    return row._record.asDict()


def manifest_publisher(spark: SparkSession, write: Write) -> Callable[[str, int, int], None]:
    """Publishes a manifest as a record with the constant key, of which a compacted topic keeps the last."""

    def publish(snapshot_id: str, offset: int, now: int) -> None:
        row = spark.createDataFrame([(snapshot_id, offset, now)], MANIFEST)
        write(row.select(F.lit(MANIFEST_KEY).alias("key"), encode(row.columns).alias("value")))

    return publish


def changelog_records(deltas: DataFrame) -> DataFrame:
    """(key, value) of changelog records: a key's records go to one partition, in order."""
    return deltas.select("key", encode(["key", "seq", "delta", "deltaQty", "ts"]).alias("value"))


def placed_changelog(records: DataFrame) -> DataFrame:
    """(pos, bytes, _bad, key, seq, delta, deltaQty, ts) of a topic's records (partition, offset, value).

    pos is the offset counted from 1. A key's records are in one partition, so within a
    key they are in order; the gate needs no more.
    """
    read = parsed(records.select((F.col("offset") + 1).alias("pos"), F.col("value").cast("string").alias("value"), F.octet_length("value").cast("bigint").alias("bytes")), DELTA)
    return read.select("pos", "bytes", "_bad", "_record.*")


def heads(records: DataFrame) -> DataFrame:
    """(partition, head): the last offset of each partition that has records."""
    return records.groupBy("partition").agg(F.max("offset").alias("head"))
