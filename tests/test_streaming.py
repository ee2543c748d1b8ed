"""Streams against batches, restarts, sinks, metrics, settings."""

import pytest
from pyspark.sql import functions as F

from tidewheel.jobs import config as C
from tidewheel.jobs import main as jobs
from tidewheel.operators import aggregate as A
from tidewheel.plans import catalogue, recovery
from tidewheel.schemas import ENRICHED
from tidewheel.sources import files, kafka
from tidewheel.streaming import jobs as J
from tidewheel.streaming import metrics, sinks


def stream_of(spark, df, path, parts=3):
    for k in range(parts):
        df.where(F.expr(f"off % {parts} = {k}")).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(f"off bigint, {ENRICHED}").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def test_restart_after_failures_counts_once(spark, sf_dir, tmp_path):
    orders = catalogue._enriched(spark, sf_dir)
    J.use_rocksdb(spark)
    stream = stream_of(spark, orders, tmp_path / "in")
    sums, write = J.window_sums(stream, 86400), sinks.epochs(str(tmp_path / "out"))
    failures = iter(["before", "after", None])
    how = next(failures)

    def fragile(batch, epoch):
        if epoch == 1 and how == "before":
            raise RuntimeError("before the write")
        write(batch, epoch)
        if epoch == 1 and how == "after":
            raise RuntimeError("after the write")

    for k in range(3):
        query = J.start(sums, fragile, str(tmp_path / "ck"), f"restart{k}")
        if how:
            with pytest.raises(Exception, match="the write"):
                query.awaitTermination()
        else:
            query.awaitTermination()
        how = next(failures, None)
    got = sinks.read_upserts(spark, str(tmp_path / "out"), ["key"], ["lastSeq"]).select("key", "sumAmount", "sumQty", "lastSeq")
    want = A.final(orders, 86400).select("key", "sumAmount", "sumQty", "lastSeq")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_outputs_go_on_from_a_snapshot(spark, sf_dir, tmp_path):
    orders = catalogue._enriched(spark, sf_dir)
    J.use_rocksdb(spark)
    first = A.final(orders.where("off < 500"), 86400).select("key", F.col("sumAmount").alias("SumAmount"), F.col("sumQty").alias("SumQty"), F.col("lastSeq").alias("LastSeq"))
    stream = stream_of(spark, orders.where("off >= 500"), tmp_path / "in", 1)
    J.start(J.running_outputs(stream, 86400, first), sinks.epochs(str(tmp_path / "out")), str(tmp_path / "ck"), "resumed").awaitTermination()
    got = sinks.read_epochs(spark, str(tmp_path / "out")).select("off", "key", "seq", "sumAmount", "sumQty")
    want = A.running(orders, "off", 86400).where("off >= 500").select("off", "key", "seq", "sumAmount", "sumQty")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_watermark_drops_late_windows(spark, tmp_path):
    kind = f"off bigint, {ENRICHED}"
    hours = [0, 1, 10, 11, 0, 12]  # the second record of hour 0 comes when the watermark has passed it
    for i, h in enumerate(hours):
        spark.createDataFrame([(i, "o", "p", 100, 1, "s", h * 3600, True, h * 3600)], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    for mark, count in (("1 hour", 1), (None, 2)):
        out = str(tmp_path / f"out{mark}")
        J.start(J.window_sums(stream, 3600, mark), sinks.epochs(out), f"{tmp_path}/ck{mark}", f"marked{count}").awaitTermination()
        got = {r.windowStart: r.lastSeq for r in sinks.read_upserts(spark, out, ["key"], ["lastSeq"]).collect()}
        assert got == {0: count, 3600: 1, 36000: 1, 39600: 1, 43200: 1}


def test_fan_out_stops_at_the_first_error(spark):
    met = []

    def fail(_):
        raise ValueError("full")

    with pytest.raises(ValueError):
        sinks.fan_out([lambda b: met.append(b.count()), fail, lambda b: met.append(0)])(spark.range(3), 0)
    assert met == [3]


def test_listener_counts_batches(spark, tmp_path):
    registry = metrics.Registry()
    listener = metrics.Listener(registry)
    spark.streams.addListener(listener)
    spark.range(10).write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in")).observe("changelog", F.count(F.lit(1)).alias("appended"))
    J.start(df, lambda b, e: b.count(), str(tmp_path / "ck"), "listened", mode="append").awaitTermination()
    import time

    for _ in range(50):
        if registry.get("opb_tx_produced_total"):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert registry.get("opb_tx_produced_total") == 1 and registry.get("opb_changelog_appended_total") == 10
    text = registry.text()
    assert "opb_tx_latency_seconds_count 1" in text and "# TYPE opb_partition_lag gauge" in text


def test_offsets_behind():
    assert metrics.offsets_behind('{"t":{"0":10,"1":5}}', '{"t":{"0":7,"1":9}}') == {("t", "0"): 3, ("t", "1"): 0}
    assert metrics.offsets_behind(None, None) == {} and metrics.offsets_behind("3", "2") == {}
    assert metrics.health() == '{"status": "ok"}'


def test_metrics_are_served():
    import urllib.error
    import urllib.request

    registry = metrics.Registry()
    registry.set("opb_changelog_lag", 3)
    server = metrics.serve(registry, "127.0.0.1:0")
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", timeout=5).read().decode()
    assert "opb_changelog_lag 3" in get("/metrics") and get("/healthz") == '{"status": "ok"}'
    with pytest.raises(urllib.error.HTTPError):
        get("/other")
    server.shutdown()
    server.server_close()


def test_kafka_options():
    assert kafka.brokers(" a:1, ,b:2,") == ["a:1", "b:2"]
    source = kafka.source_options("a:1,b:2", "t", "g", 1000)
    assert source["kafka.isolation.level"] == "read_committed" and source["startingOffsets"] == "earliest" and source["maxOffsetsPerTrigger"] == "1000"
    assert kafka.sink_options("a:1", "t")["kafka.acks"] == "all"
    with pytest.raises(ValueError):
        kafka.source_options(" , ", "t")


def test_settings():
    c = C.parse(C.Aggregate, ["--window-size", "60", "--once", "--changelog", "false"])
    assert (c.window_size, c.once, c.changelog, c.tx_batch_size, c.tx_linger_ms) == (60, True, False, 1000, 100)
    with pytest.raises(SystemExit):
        C.parse(C.Aggregate, ["--input-source", "kafka"])
    with pytest.raises(SystemExit):
        C.parse(C.Aggregate, ["--state-backend", "other"])


def test_jobs_run_on_files(spark, tmp_path, capsys):
    jobs.generate(spark, C.Generate(count=200, output=str(tmp_path / "orders")))
    paths = {"output_path": str(tmp_path / "out"), "state_dir": str(tmp_path / "ck"), "changelog_path": str(tmp_path / "log"), "snapshot_dir": str(tmp_path / "snap")}
    c = C.Aggregate(input_source="file", input_path=str(tmp_path / "orders"), once=True, http="127.0.0.1:0", **paths)
    registry, sent = metrics.Registry(), []
    jobs.aggregate(spark, c, registry, lambda df, topic: sent.append(topic))
    assert registry.get("opb_changelog_appended_total") == 200 and not sent
    state = recovery.restore_and_replay(spark, c.snapshot_dir, c.changelog_path)
    assert state.next_offset == 200 and state.applied == 0 and state.state.agg(F.sum("LastSeq")).first()[0] == 200
    # A new checkpoint goes on from the snapshot; a batch that fails after its changelog is repeated without harm.
    again = C.Aggregate(input_source="file", input_path=str(tmp_path / "orders"), once=True, manifest_sink="both", changelog_sink="both", kafka_bootstrap="none:1", **paths | {"state_dir": str(tmp_path / "ck9"), "output_path": str(tmp_path / "out9"), "changelog_path": str(tmp_path / "log9")})
    files.append_changelog(files.read_changelog(spark, c.changelog_path).drop("pos", "bytes"), again.changelog_path, epoch=0, order=("key", "seq"))

    def broken(df, topic):
        sent.append(topic)
        if len(sent) == 1:
            raise RuntimeError("the topic is away")

    with pytest.raises(Exception, match="away"):
        jobs.aggregate(spark, again, registry, broken)
    jobs.aggregate(spark, again, registry, broken)
    assert set(sent) == {"p2.opb-changelog", "p2.opb-snapshots"}
    rows = sinks.read_upserts(spark, again.output_path, ["key"], ["lastSeq"])
    assert rows.agg(F.sum("lastSeq")).first()[0] == 400
    assert sinks.read_upserts(spark, str(tmp_path / "out"), ["key"], ["lastSeq"]).agg(F.sum("lastSeq")).first()[0] == 200
    e = C.Enrich(input_path=str(tmp_path / "orders"), output_path=str(tmp_path / "enriched"), state_dir=str(tmp_path / "ck2"), once=True)
    jobs.enrich(spark, e).awaitTermination()
    assert sinks.read_epochs(spark, str(tmp_path / "enriched")).count() == 200
    jobs.aggregate(spark, C.Aggregate())
    assert "seq=2" in capsys.readouterr().out
