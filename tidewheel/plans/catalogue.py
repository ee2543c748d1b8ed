"""The queries of the engine over the driver's tables, and the same in SQL.

Orders are made of `events`: event_id is the arrival position, so results that depend on
the order of arrival are exact. The changelog of the replay queries restarts its sequence
numbers and leaves gaps, as after crashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.codec import decode, encode
from tidewheel.functions.keys import amount, output_key, window_start
from tidewheel.operators import aggregate as A
from tidewheel.operators import compaction, lag, replay
from tidewheel.operators import orders as O
from tidewheel.plans import recovery, scratch
from tidewheel.schemas import ENRICHED
from tidewheel.sources import files, generators, kafka
from tidewheel.streaming import jobs as J
from tidewheel.streaming import sinks

DAY, HOUR = 86400, 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders with their arrival position `off`; only the columns needed are read."""
    e = table(spark, sf_dir, "events")
    ts = F.expr("timestampdiff(SECOND, timestamp_ntz '1970-01-01 00:00:00', date_trunc('SECOND', ts))").cast("bigint")
    return e.select(
        F.col("event_id").alias("off"), F.concat(F.lit("o"), F.col("event_id").cast("string")).alias("orderId"), F.col("event_type").alias("productId"),
        F.round(F.col("value") * 100).cast("bigint").alias("price"), (1 + F.col("event_id") % 5).alias("qty"), F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("storeId"), ts.alias("ts"),
    )


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As from a producer that marks every tenth order as not validated."""
    return O.normalize(_orders(spark, sf_dir)).withColumn("validated", F.col("off") % 10 != 0)


def _changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rank = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    seq = F.when(F.col("event_id") % 11 == 0, 1).otherwise(rank + F.when(F.col("event_id") % 13 == 0, 2).otherwise(0))
    return e.select(
        (F.col("event_id") + 1).alias("pos"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("#"), "event_type").alias("key"), seq.cast("bigint").alias("seq"),
        F.round(F.col("value") * 100).cast("bigint").alias("delta"), (1 + F.col("event_id") % 5).alias("deltaQty"),
    )


def normalize_orders(spark, sf_dir):
    return O.normalize(_orders(spark, sf_dir))


def window_starts(spark, sf_dir):
    return _enriched(spark, sf_dir).select("off", *[window_start("normTs", w).alias(n) for w, n in ((0, "w_default"), (HOUR, "w_hour"))], window_start(F.col("normTs") * 0 - F.col("off"), 300).alias("w_before_1970"))


def output_keys(spark, sf_dir):
    return O.keyed(_enriched(spark, sf_dir)).select("off", "key")


def order_amount(spark, sf_dir):
    return _orders(spark, sf_dir).select("off", amount().alias("amount"))


def _final(seconds):
    return lambda spark, sf_dir: A.final(_enriched(spark, sf_dir), seconds)


def _running(seconds):
    return lambda spark, sf_dir: A.running(_enriched(spark, sf_dir), "off", seconds)


def changelog_deltas(spark, sf_dir):
    return A.deltas(A.running(_enriched(spark, sf_dir), "off", DAY))


def compact_latest_output(spark, sf_dir):
    out = A.running(_enriched(spark, sf_dir), "off", DAY).select(*A.GROUP, "key", "off", "seq", "sumAmount", "sumQty")
    return compaction.latest(out, A.GROUP, "off").select("key", "off", "seq", "sumAmount", "sumQty")  # by the columns that the sums are dealt by: no second shuffle


def replay_flags(spark, sf_dir):
    return replay.flags(_changelog(spark, sf_dir))


def replay_counts(spark, sf_dir):
    return replay.counts(replay_flags(spark, sf_dir))


def replay_state(spark, sf_dir):
    return replay.state(_changelog(spark, sf_dir))


def replay_from_offset(spark, sf_dir):
    return replay.state(_changelog(spark, sf_dir), from_offset=4000)


def restore_replay_state(spark, sf_dir):
    log = _changelog(spark, sf_dir)
    snapshot = log.where("pos <= 2000").groupBy("key").agg(F.sum("delta").cast("bigint").alias("SumAmount"), F.sum("deltaQty").cast("bigint").alias("SumQty"), F.max("seq").alias("LastSeq"))
    return replay.state(log, snapshot, from_offset=1500)


def state_get(spark, sf_dir):
    return replay.get(replay_state(spark, sf_dir), "u1#click")


def decode_orders(spark, sf_dir):
    return decode(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value")), "k bigint, missing string")


def encode_output(spark, sf_dir):
    return O.keyed(_enriched(spark, sf_dir)).select("off", encode(["key", "price", "qty", "validated"]).alias("value"))


def replay_bytes(spark, sf_dir):
    return replay.value_bytes(_changelog(spark, sf_dir).select(encode(["key", "seq", "delta", "deltaQty"]).alias("value")))


def batch_offsets(spark, sf_dir):
    return A.batch_offsets(table(spark, sf_dir, "events"), F.expr("event_id div 1000"), F.col("user_id") % 6, "event_id")


def partition_lag(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 6).alias("partition"), "event_id", "event_type")
    heads = e.groupBy("partition").agg(F.max("event_id").alias("head"))
    at = e.where("event_type = 'click'").groupBy("partition").agg((F.max("event_id") + 1).alias("position"))
    return lag.partition_lag(heads, at)


def validated_only(spark, sf_dir):
    return O.validated_only(_enriched(spark, sf_dir)).groupBy("storeId").agg(F.sum(amount()).cast("bigint").alias("sumAmount"), F.count("*").alias("orders"))


def lineitem_agg_final(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return line.groupBy("l_suppkey", "l_partkey").agg(F.sum(cents).cast("bigint").alias("sumAmount"), F.sum(F.col("l_quantity").cast("bigint")).cast("bigint").alias("sumQty"), F.count("*").alias("lastSeq"))


def passthrough(spark, sf_dir):
    return O.passthrough(O.keyed(_enriched(spark, sf_dir)).select("key", encode(["orderId", "price", "qty"]).alias("value"), "off"))


def snapshot_dump(spark, sf_dir):
    """Written as a snapshot and read back."""
    base = scratch.folder(spark)
    files.write_snapshot(spark, replay_state(spark, sf_dir), base, "20250101T000000Z")
    return files.read_snapshot(spark, base, "20250101T000000Z")


def snapshot_interchange(spark, sf_dir):
    """Written as a snapshot and read back from its interchange file."""
    base = scratch.folder(spark)
    files.write_snapshot(spark, replay_state(spark, sf_dir), base, "20250101T000000Z", interchange=True)
    return files.read_interchange(spark, f"{base}/20250101T000000Z/state.json")


def changelog_scan(spark, sf_dir):
    """A log of three appends, read back with its places."""
    base, log = scratch.folder(spark), _changelog(spark, sf_dir).withColumn("ts", F.lit(1).cast("bigint"))
    for part in ("pos <= 100", "pos > 100 and pos <= 5000", "pos > 5000"):
        files.append_changelog(log.where(part), f"{base}/changelog", order=("pos",))
    return files.read_changelog(spark, f"{base}/changelog").select("pos", "key", "seq", "delta", "deltaQty")


def recovery_counts(spark, sf_dir):
    """Manifest, snapshot of the first 400 changes and a changelog on files: what the recovery of all counts."""
    base, log = scratch.folder(spark), _changelog(spark, sf_dir).withColumn("ts", F.lit(1).cast("bigint"))
    files.append_changelog(log, f"{base}/changelog", order=("pos",))
    files.advance(spark, replay.state(log.where("pos <= 400")), base, "20250101T000000Z", 400, 1)
    found = recovery.restore_and_replay(spark, base, f"{base}/changelog")
    return found.state.agg(F.lit(found.applied).cast("bigint").alias("applied"), F.lit(found.skipped).cast("bigint").alias("skipped"), F.lit(found.next_offset).cast("bigint").alias("nextOffset"), F.sum("SumAmount").cast("bigint").alias("sumAmount"), F.count("*").alias("keys"))


def kafka_replay_state(spark, sf_dir):
    """The state from changelog records as a topic of six partitions has them."""
    log = _changelog(spark, sf_dir).withColumn("ts", F.lit(1).cast("bigint"))
    records = log.select(F.pmod(F.xxhash64("key"), F.lit(6)).cast("int").alias("partition"), (F.col("pos") - 1).alias("offset"), encode(["key", "seq", "delta", "deltaQty", "ts"]).alias("value"))
    return replay.state(kafka.placed_changelog(records).where("not _bad"))


def aggregator_job(spark, sf_dir):
    """The service over files: orders in, outputs, changelog, snapshot and manifest out; the state that its own files recover to."""
    from tidewheel.jobs import config, main

    base = scratch.folder(spark)
    rows = _enriched(spark, sf_dir)
    rows.select(encode([c for c in rows.columns if c != "off"]).alias("value")).write.text(f"{base}/in")
    paths = {"input_path": f"{base}/in", "output_path": f"{base}/out", "changelog_path": f"{base}/changelog", "snapshot_dir": f"{base}/snapshots", "state_dir": f"{base}/checkpoint"}
    main.aggregate(spark, config.Aggregate(instance_id=base[-12:], input_source="file", once=True, window_size=DAY, **paths))
    return recovery.restore_and_replay(spark, f"{base}/snapshots", f"{base}/changelog").state


def manifest_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("snapshotId"), (F.col("event_id") * 2).alias("lastChangelogOffset"), F.col("user_id").alias("createdAt")))
    key = F.when(F.col("event_id") % 7 == 0, F.lit("other")).otherwise(F.lit(kafka.MANIFEST_KEY))
    return kafka.manifest_latest(e.select(key.alias("key"), record.alias("value"), F.col("event_id").alias("offset")))


def _streamed(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """The enriched orders as a stream of files in the order of arrival, one in a batch."""
    source = _enriched(spark, sf_dir)
    for k in range(3):
        source.where(F.expr(f"(off div 1000) % 3 = {k}")).coalesce(1).write.parquet(f"{base}/in/part={k}")
    kind = f"off bigint, {ENRICHED}"
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")


def stream_window_agg(spark, sf_dir):
    """The streaming sums, drained in several batches; the sink's table equals the batch result."""
    base = scratch.folder(spark)
    J.use_rocksdb(spark)
    out = J.window_sums(_streamed(spark, sf_dir, base), DAY)
    J.start(out, sinks.epochs(f"{base}/out"), f"{base}/checkpoint", f"sums-{base[-12:]}").awaitTermination()
    return sinks.read_upserts(spark, f"{base}/out", ["key"], ["lastSeq"]).select("key", *A.GROUP, "sumAmount", "sumQty", "lastSeq")


def stateful_running_output(spark, sf_dir):
    """One output for each record, with state kept between batches."""
    base = scratch.folder(spark)
    J.use_rocksdb(spark)
    source = _enriched(spark, sf_dir)
    for k, part in enumerate(("off < 4000", "off >= 4000")):
        source.where(part).coalesce(1).write.parquet(f"{base}/in/{k}")
    stream = spark.readStream.schema(f"off bigint, {ENRICHED}").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    J.start(J.running_outputs(stream, DAY), sinks.epochs(f"{base}/out"), f"{base}/checkpoint", f"running-{base[-12:]}").awaitTermination()
    return sinks.read_epochs(spark, f"{base}/out").drop("epoch", *A.GROUP)


def enrich_stream(spark, sf_dir):
    """Raw JSON orders to enriched JSON records, streamed."""
    base = scratch.folder(spark)
    raw = _orders(spark, sf_dir)
    raw.select(encode(["orderId", "productId", "price", "qty", "storeId", "ts"]).alias("value")).write.text(f"{base}/in")
    out = J.enrich(spark.readStream.text(f"{base}/in"))
    J.start(out, sinks.epochs(f"{base}/out"), f"{base}/checkpoint", f"enrich-{base[-12:]}", mode="append").awaitTermination()
    return decode(sinks.read_epochs(spark, f"{base}/out").select("value"), ENRICHED)


def sample_orders(spark, sf_dir):
    return A.final(generators.sample_orders(spark))


def gen_orders(spark, sf_dir):
    return generators.gen_orders(spark, 1000)


QUERIES = {
    "normalize_orders": normalize_orders, "window_start": window_starts, "output_key": output_keys, "order_amount": order_amount,
    "window_agg_final": _final(300), "window_agg_final_hour": _final(HOUR), "window_agg_final_day": _final(DAY),
    "running_output": _running(300), "running_output_day": _running(DAY), "changelog_deltas": changelog_deltas, "compact_latest_output": compact_latest_output,
    "replay_flags": replay_flags, "replay_counts": replay_counts, "replay_state": replay_state, "replay_from_offset": replay_from_offset, "restore_replay_state": restore_replay_state,
    "state_get": state_get, "decode_orders": decode_orders, "encode_output": encode_output, "replay_bytes": replay_bytes, "batch_offsets": batch_offsets, "partition_lag": partition_lag,
    "validated_only": validated_only, "lineitem_agg_final": lineitem_agg_final, "passthrough": passthrough, "snapshot_dump": snapshot_dump, "snapshot_interchange": snapshot_interchange, "changelog_scan": changelog_scan,
    "recovery_counts": recovery_counts, "kafka_replay_state": kafka_replay_state, "aggregator_job": aggregator_job, "manifest_latest": manifest_latest,
    "stream_window_agg": stream_window_agg, "stateful_running_output": stateful_running_output, "enrich_stream": enrich_stream, "sample_orders": sample_orders, "gen_orders": gen_orders,
}

_RAW = """select event_id as off, 'o' || event_id as orderId, event_type as productId, cast(round(value * 100) as bigint) as price,
  1 + event_id % 5 as qty, 'S' || (user_id % 4) as storeId, cast(floor(epoch(ts)) as bigint) as ts"""
_ORD = f"({_RAW}, event_id % 10 <> 0 as validated, cast(floor(epoch(ts)) as bigint) as normTs from events)"


def _keyed_sql(w: int) -> str:
    return f"(select *, (normTs // {w}) * {w} as windowStart, storeId || '#' || productId || '#' || ((normTs // {w}) * {w}) as key from {_ORD} o)"


def _final_sql(w: int) -> str:
    return f"select key, storeId, productId, windowStart, cast(sum(price * qty) as bigint) as sumAmount, cast(sum(qty) as bigint) as sumQty, count(*) as lastSeq from {_keyed_sql(w)} k group by all"


def _run_sql(w: int) -> str:
    return f"""(select off, key, storeId, productId, windowStart, row_number() over w as seq, price * qty as delta, qty as deltaQty,
      cast(sum(price * qty) over w as bigint) as sumAmount, cast(sum(qty) over w as bigint) as sumQty
      from {_keyed_sql(w)} k window w as (partition by key order by off rows between unbounded preceding and current row))"""


_CL = """(select event_id + 1 as pos, 'u' || user_id || '#' || event_type as key,
  cast(case when event_id % 11 = 0 then 1 else row_number() over (partition by user_id, event_type order by event_id)
    + case when event_id % 13 = 0 then 2 else 0 end end as bigint) as seq,
  cast(round(value * 100) as bigint) as delta, 1 + event_id % 5 as deltaQty from events)"""


def _flag_sql(offset: int = 0) -> str:
    return f"""(select pos, key, seq, delta, deltaQty, seq > greatest(0, coalesce(max(seq) over (partition by key order by pos
      rows between unbounded preceding and 1 preceding), 0)) as applied from {_CL} c where pos > {offset})"""


def _state_sql(offset: int = 0) -> str:
    return f"select key, cast(sum(delta) as bigint) as SumAmount, cast(sum(deltaQty) as bigint) as SumQty, max(seq) as LastSeq from {_flag_sql(offset)} f where applied group by key"


_RESTORE = f"""
with snap as (select key, cast(sum(delta) as bigint) as sa, cast(sum(deltaQty) as bigint) as sq, max(seq) as ls from {_CL} c where pos <= 2000 group by key),
j as (select t.*, greatest(coalesce(s.ls, 0), coalesce(max(t.seq) over (partition by t.key order by t.pos rows between unbounded preceding and 1 preceding), 0)) as pm
      from (select * from {_CL} c where pos > 1500) t left join snap s on t.key = s.key),
a as (select key, cast(sum(delta) as bigint) as sa, cast(sum(deltaQty) as bigint) as sq, max(seq) as ls from j where seq > pm group by key)
select coalesce(s.key, a.key) as key, coalesce(s.sa, 0) + coalesce(a.sa, 0) as SumAmount, coalesce(s.sq, 0) + coalesce(a.sq, 0) as SumQty, coalesce(a.ls, s.ls) as LastSeq
from snap s full outer join a on s.key = a.key
"""

SQL = {
    "normalize_orders": f"{_RAW}, true as validated, cast(floor(epoch(ts)) as bigint) as normTs from events",
    "window_start": f"select off, (normTs // 300) * 300 as w_default, (normTs // 3600) * 3600 as w_hour, (-off // 300) * 300 as w_before_1970 from {_ORD} o",
    "output_key": f"select off, key from {_keyed_sql(300)} k",
    "order_amount": f"select off, price * qty as amount from {_ORD} o",
    "window_agg_final": _final_sql(300),
    "window_agg_final_hour": _final_sql(HOUR),
    "window_agg_final_day": _final_sql(DAY),
    "running_output": f"select * from {_run_sql(300)} r",
    "running_output_day": f"select * from {_run_sql(DAY)} r",
    "changelog_deltas": f"select key, seq, delta, deltaQty from {_run_sql(DAY)} r",
    "compact_latest_output": f"select key, max(off) as off, arg_max(seq, off) as seq, arg_max(sumAmount, off) as sumAmount, arg_max(sumQty, off) as sumQty from {_run_sql(DAY)} r group by key",
    "replay_flags": f"select * from {_flag_sql()} f",
    "replay_counts": f"select count(*) filter (applied) as applied, count(*) filter (not applied) as skipped, coalesce(max(pos), -1) as lastOffset from {_flag_sql()} f",
    "replay_state": _state_sql(),
    "replay_from_offset": _state_sql(4000),
    "restore_replay_state": _RESTORE,
    "state_get": f"select * from ({_state_sql()}) s where key = 'u1#click'",
    "decode_orders": "select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), 0) as k, '' as missing from events",
    "encode_output": f"select off, '{{\"key\":\"' || key || '\",\"price\":' || price || ',\"qty\":' || qty || ',\"validated\":' || validated || '}}' as value from {_keyed_sql(300)} k",
    "replay_bytes": f"select cast(sum(octet_length(encode('{{\"key\":\"' || key || '\",\"seq\":' || seq || ',\"delta\":' || delta || ',\"deltaQty\":' || deltaQty || '}}'))) as bigint) as bytes from {_CL} c",
    "batch_offsets": "select event_id // 1000 as batch, user_id % 6 as partition, max(event_id) + 1 as nextOffset from events group by all",
    "partition_lag": """select h.partition, greatest(h.head + 1 - coalesce(p.position, 0), 0) as lag
      from (select user_id % 6 as partition, max(event_id) as head from events group by all) h
      left join (select user_id % 6 as partition, max(event_id) + 1 as position from events where event_type = 'click' group by all) p on h.partition = p.partition""",
    "validated_only": f"select storeId, cast(sum(price * qty) as bigint) as sumAmount, count(*) as orders from {_ORD} o where validated group by storeId",
    "lineitem_agg_final": "select l_suppkey, l_partkey, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as sumAmount, cast(sum(cast(l_quantity as bigint)) as bigint) as sumQty, count(*) as lastSeq from lineitem group by all",
    "passthrough": f"select key, '{{\"orderId\":\"' || orderId || '\",\"price\":' || price || ',\"qty\":' || qty || '}}' as value from {_keyed_sql(300)} k",
    "snapshot_dump": _state_sql(),
    "snapshot_interchange": _state_sql(),
    "changelog_scan": f"select pos, key, seq, delta, deltaQty from {_CL} c",
    "kafka_replay_state": _state_sql(),
    "recovery_counts": f"""select (select count(*) from {_flag_sql()} f where applied and pos > 400) as applied, (select count(*) from {_flag_sql()} f where not applied and pos > 400) as skipped,
      (select max(pos) from {_CL} c) as nextOffset, cast(sum(SumAmount) as bigint) as sumAmount, count(*) as keys from ({_state_sql()}) s""",
    "aggregator_job": f"select key, sumAmount as SumAmount, sumQty as SumQty, lastSeq as LastSeq from ({_final_sql(DAY)}) f",
    "manifest_latest": "select 's' || event_id as snapshotId, event_id * 2 as lastChangelogOffset, user_id as createdAt from events where event_id % 7 <> 0 order by event_id desc limit 1",
    "stream_window_agg": _final_sql(DAY),
    "stateful_running_output": f"select off, key, seq, delta, deltaQty, sumAmount, sumQty from {_run_sql(DAY)} r",
    "enrich_stream": f"select orderId, productId, price, qty, storeId, ts, true as validated, normTs from {_ORD} o",
    "sample_orders": "select * from (values ('A#p1#1694499900', 'A', 'p1', cast(1694499900 as bigint), cast(30000 as bigint), cast(3 as bigint), cast(2 as bigint)), ('A#p2#1694499900', 'A', 'p2', 1694499900, 15000, 3, 1)) t(key, storeId, productId, windowStart, sumAmount, sumQty, lastSeq)",
}
