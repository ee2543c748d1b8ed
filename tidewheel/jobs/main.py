"""Command-line jobs: python -m tidewheel.jobs.main enrich|aggregate|recover|generate [flags]."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.codec import decode, encode
from tidewheel.jobs import config as C
from tidewheel.operators import aggregate as A
from tidewheel.operators import orders as O
from tidewheel.plans import recovery
from tidewheel.schemas import ENRICHED
from tidewheel.sources import files, generators, kafka
from tidewheel.streaming import jobs as J
from tidewheel.streaming import metrics, sinks


def _trigger(once: bool, linger_ms: int = 100) -> dict:
    return {"availableNow": True} if once else {"processingTime": f"{linger_ms} milliseconds"}


def _stream(spark: SparkSession, bootstrap: str, topic: str, path: str, group: str | None = None, most: int | None = None):
    """(key, value) records from a topic, or from files of text lines."""
    if bootstrap:
        return kafka.read_stream(spark, kafka.source_options(bootstrap, topic, group, most))
    return spark.readStream.option("maxFilesPerTrigger", 16).text(path).withColumn("key", F.lit(None).cast("string"))


def enrich(spark: SparkSession, c: C.Enrich):
    """Raw orders to enriched ones (or, as wrapper, enriched ones on to the output), until stopped or drained."""
    wrapper = c.mode == "wrapper"
    raw = _stream(spark, c.kafka_bootstrap, c.topic_enriched if wrapper else c.topic_orders, c.input_path)
    out = O.passthrough(raw) if wrapper else J.enrich(raw)
    topic = c.output_topic if wrapper else c.topic_enriched
    write = sinks.fan_out([kafka.writer(kafka.sink_options(c.kafka_bootstrap, topic))]) if c.kafka_bootstrap else sinks.epochs(c.output_path)
    return J.start(out, write, c.state_dir, "enrich", _trigger(c.once), "append")


class Service:
    """What the aggregator does with each batch of outputs: sinks, changelog, and now and then a snapshot with its manifest.

    A batch that is repeated writes its epoch's folders again, with the same rows; so
    places in the changelog, and a manifest's offset over them, hold. `send` writes a frame
    of (key, value) to a topic.
    """

    def __init__(self, spark: SparkSession, c: C.Aggregate, registry: metrics.Registry, send=None):
        self.spark, self.c, self.registry, self.last = spark, c, registry, time.time()
        self.send = send or (lambda df, topic: kafka.writer(kafka.sink_options(c.kafka_bootstrap, topic))(df))
        self.first = 0  # epoch of the changelog that the checkpoint's first batch writes

    def begin(self):
        """The state to start from, or None. A new checkpoint counts its batches from 0 again, but its changelog goes on after what is there, and its state from what that recovers to; both are noted, so that a restart before the first commit finds them, and not what the batch that failed has left."""
        c, note = self.c, f"{self.c.state_dir}.start"
        if not files.exists(self.spark, c.state_dir):
            name = ""
            if files.exists(self.spark, f"{c.snapshot_dir}/{files.MANIFEST_FILE}") and files.exists(self.spark, c.changelog_path):
                # Written, as a stream's plan can't hold the replay.
                name = recovery.snapshot_and_advance(self.spark, recovery.restore_and_replay(self.spark, c.snapshot_dir, c.changelog_path), c.snapshot_dir)
            files.write_text(self.spark, note, f"{files.next_epoch(self.spark, c.changelog_path)} {name}")
        if not files.exists(self.spark, note):
            return None
        first, name = self.spark.read.text(note).first().value.split(" ")
        self.first = int(first)
        fresh = not files.exists(self.spark, f"{c.state_dir}/commits/0")
        return files.read_snapshot(self.spark, c.snapshot_dir, name) if name and fresh else None

    def publishers(self) -> list:
        c, out = self.c, []
        if c.manifest_sink in ("file", "both"):
            out.append(files.manifest_publisher(self.spark, c.snapshot_dir))
        if c.manifest_sink in ("kafka", "both"):
            out.append(kafka.manifest_publisher(self.spark, lambda df: self.send(df, c.topic("snapshots"))))
        return out

    def writers(self, epoch: int) -> list:
        """The batch's writers, in order; the first error stops the rest, and the batch is repeated."""
        c = self.c
        out = [lambda b: sinks.epochs(c.output_path)(b.select("key", *A.GROUP, "sumAmount", "sumQty", F.col("seq").alias("lastSeq")), epoch)]
        if c.input_source == "kafka":
            out = [lambda b: self.send(J.output_records(b, F.unix_timestamp()), c.topic("output"))]
        if c.changelog and c.changelog_sink in ("file", "both"):
            out.append(lambda b: files.append_changelog(b.withColumn("ts", F.unix_timestamp()), c.changelog_path, self.first + epoch, ("off", "key", "seq")))
        if c.changelog and c.changelog_sink in ("kafka", "both"):
            out.append(lambda b: self.send(kafka.changelog_records(A.deltas(b, F.unix_timestamp())), c.topic("changelog")))
        if c.changelog:
            out.append(lambda b: self.registry.add("opb_changelog_appended_total", b.count()))
        return out

    def batch(self, outputs, epoch: int) -> None:
        sinks.fan_out(self.writers(epoch))(outputs, epoch)
        if 0 < self.c.snapshot_interval <= time.time() - self.last:
            self.snapshot()

    def snapshot(self) -> str | None:
        """The state so far, by replay of the changelog files over the last snapshot; without such files there is nothing to make it of."""
        c, self.last = self.c, time.time()
        if not c.changelog or c.changelog_sink == "kafka" or not files.exists(self.spark, c.changelog_path):
            return None
        none = {"snapshotId": "", "lastChangelogOffset": 0, "createdAt": 0}
        before = files.read_manifest(self.spark, c.snapshot_dir) if files.exists(self.spark, f"{c.snapshot_dir}/{files.MANIFEST_FILE}") else none
        return recovery.snapshot_and_advance(self.spark, recovery.restore_and_replay(self.spark, c.snapshot_dir, c.changelog_path, before), c.snapshot_dir, publish=self.publishers())


def aggregate(spark: SparkSession, c: C.Aggregate, registry: metrics.Registry | None = None, send=None):
    """Windowed sums, one output for each record, until stopped or (once) drained; state that a checkpoint doesn't hold starts from the last snapshot."""
    registry = registry or metrics.Registry()
    service = Service(spark, c, registry, send)
    if c.http:
        metrics.serve(registry, c.http)
    if c.input_source == "sample":
        out = A.running(generators.sample_orders(spark).withColumn("off", F.col("ts")), "off", c.window_size)
        for r in out.orderBy("off").collect():  # three rows
            print(f"orders.output key={r.key} seq={r.seq} value={{{r.sumAmount}, {r.sumQty}}}")
        return None
    if c.state_backend == "rocksdb":
        J.use_rocksdb(spark)
    from_kafka = c.input_source == "kafka"
    records = _stream(spark, c.kafka_bootstrap if from_kafka else "", c.topic_enriched, c.input_path, c.group_id, c.tx_batch_size)
    if from_kafka:  # the order of arrival, as far as a topic of several partitions has one
        ready = decode(records.select("value", F.shiftleft("partition", 48).bitwiseOR(F.col("offset")).alias("off")), ENRICHED)
    else:
        ready = decode(records.select("value"), ENRICHED).withColumn("off", F.col("normTs"))
    initial = service.begin()
    outputs = J.running_outputs(O.validated_only(ready, c.require_validated), c.window_size, initial)
    listener = metrics.Listener(registry, c.group_id, c.instance_id)
    spark.streams.addListener(listener)
    query = J.start(outputs, service.batch, c.state_dir, f"aggregate-{c.instance_id or c.group_id}", _trigger(c.once, c.tx_linger_ms))
    if c.once:
        try:
            query.awaitTermination()
        finally:
            spark.streams.removeListener(listener)
        if c.snapshot_interval > 0:
            service.snapshot()
    return query


def recover(spark: SparkSession, c: C.Recover, read=None) -> metrics.Registry:
    """Recoveries, one every `poll` seconds; rounds = 0: for ever. A cycle that fails is told and tried again; `read` gives a topic's records."""
    registry, done = metrics.Registry(), 0
    read = read or (lambda topic: kafka.read_batch(spark, kafka.source_options(c.kafka_bootstrap, topic)))
    if c.http:
        metrics.serve(registry, c.http)
    while True:
        try:
            _recovered(spark, c, registry, read)
        except (ValueError, LookupError, OSError) as e:
            print(f"recovery: {e}", file=sys.stderr)
        if c.metrics_path:
            files.write_text(spark, c.metrics_path, registry.text())
        done += 1
        if done == c.rounds:
            return registry
        time.sleep(c.poll)


def _recovered(spark: SparkSession, c: C.Recover, registry: metrics.Registry, read) -> None:
    manifest = kafka.read_manifest(read(c.topic_snapshots)) if c.manifest_source == "kafka" else files.read_manifest(spark, c.snapshot_dir)
    head = None
    log = c.changelog_path
    if c.changelog_source == "kafka":
        records = read(c.topic_changelog)
        ends = {r.partition: r.head for r in kafka.heads(records).collect()}  # a row for each partition
        head, log = max(ends.values(), default=-1) + 1, kafka.placed_changelog(records)
        if len(ends) > 1:  # a single offset says nothing of several partitions: replay them all, which the gate makes harmless
            manifest = manifest | {"lastChangelogOffset": 0}
    result = recovery.restore_and_replay(spark, c.snapshot_dir, log, manifest)
    counts = {"applied": result.applied, "skipped": result.skipped, "lastOffset": result.next_offset}
    metrics.recovered(registry, counts, result.seconds, result.manifest["createdAt"], head, result.bytes)
    if c.changelog_source == "kafka":
        for partition, end in ends.items():
            registry.set("opb_partition_lag", max(0, end + 1 - result.next_offset), topic=c.topic_changelog, partition=str(partition), group=c.group_id, instance=c.instance_id)
    if c.advance_manifest and result.next_offset > result.manifest["lastChangelogOffset"]:
        send = kafka.writer(kafka.sink_options(c.kafka_bootstrap, c.topic_snapshots)) if c.manifest_source == "kafka" else None
        recovery.snapshot_and_advance(spark, result, c.snapshot_dir, publish=[kafka.manifest_publisher(spark, send)] if send else None)


def generate(spark: SparkSession, c: C.Generate) -> None:
    if c.rate > 0:
        rows = generators.load_stream(spark, c.rate, seed=c.seed)
        query = rows.select(encode(rows.columns).alias("value")).writeStream.format("text").option("path", c.output).option("checkpointLocation", f"{c.output}.checkpoint").start()
        query.awaitTermination(c.seconds)
        query.stop()
        return
    rows = generators.gen_orders(spark, c.count, int(time.time()), c.seed)
    rows.select(encode(rows.columns).alias("value")).write.mode("overwrite").text(c.output)


KINDS = {"enrich": (enrich, C.Enrich), "aggregate": (aggregate, C.Aggregate), "recover": (recover, C.Recover), "generate": (generate, C.Generate)}


def main(argv: list[str]) -> None:
    if not argv or argv[0] not in KINDS:
        raise SystemExit(__doc__)
    job, kind = KINDS[argv[0]]
    query = job(SparkSession.builder.appName(f"tidewheel-{argv[0]}").getOrCreate(), C.parse(kind, argv[1:]))
    if hasattr(query, "awaitTermination") and query.isActive:
        query.awaitTermination()


if __name__ == "__main__":
    main(sys.argv[1:])
