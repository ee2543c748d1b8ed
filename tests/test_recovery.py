"""Replay, snapshots, manifests, recovery."""

import json
import random

import pytest

from tidewheel.jobs import config as C
from tidewheel.jobs import main as jobs
from tidewheel.operators import replay
from tidewheel.plans import recovery
from tidewheel.sources import files, kafka

D = "pos bigint, key string, seq bigint, delta bigint, deltaQty bigint"
S = "key string, SumAmount bigint, SumQty bigint, LastSeq bigint"


def states(df):
    return {r.key: (r.SumAmount, r.SumQty, r.LastSeq) for r in df.collect()}


def plain(log, snapshot=None, offset=0):
    """A replay one record at a time."""
    state, applied = dict(snapshot or {}), []
    for pos, key, seq, delta, qty in sorted(log):
        if pos <= offset:
            continue
        a, q, last = state.get(key, (0, 0, 0))
        applied.append((pos, seq > last))
        if seq > last:
            state[key] = (a + delta, q + (qty or 0), seq)
    return state, applied


def test_seq_gate(spark):
    df = spark.createDataFrame([(1, "K", 1, 10, 1), (2, "K", 1, 20, 2), (3, "K", 3, 30, 3)], D)
    assert [r.applied for r in replay.flags(df).orderBy("pos").collect()] == [True, False, True]
    assert states(replay.state(df)) == {"K": (40, 4, 3)}


@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    log = [(i + 1, f"k{rng.randrange(5)}", rng.randrange(1, 12), rng.randrange(-50, 100), rng.choice([None, 1, 2])) for i in range(200)]
    snapshot = {f"k{i}": (rng.randrange(100), 3, rng.randrange(6)) for i in (0, 1, 9)}
    want, applied = plain(log, snapshot, 20)
    frame, snap = spark.createDataFrame(log, D).repartition(3), spark.createDataFrame([(k, *v) for k, v in snapshot.items()], S)
    assert states(replay.state(frame, snap, 20)) == want
    assert [(r.pos, r.applied) for r in replay.flags(frame, snap, 20).orderBy("pos").collect()] == applied
    assert tuple(replay.counts(replay.flags(frame, snap, 20)).first())[:2] == (sum(a for _, a in applied), sum(not a for _, a in applied))


def test_parallel_keys(spark):
    keys = ["A#p1#100", "A#p2#100", "B#p1#200", "C#p3#300"]
    log = [(i * 4 + j + 1, k, i + 1, 1, 1) for i in range(1000) for j, k in enumerate(keys)]
    for n in (1, 6):
        assert states(replay.state(spark.createDataFrame(log, D).repartition(n))) == {k: (1000, 1000, 1000) for k in keys}


def write(path, lines):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part-0.jsonl").write_text("".join(line + "\n" for line in lines))
    return str(path)


#: Records with a duplicate and a gap, as (seq, delta, deltaQty).
LINES = [json.dumps({"key": "K#1", "seq": s, "delta": d, "deltaQty": q, "ts": t}) for t, (s, d, q) in enumerate([(1, 10, 1), (1, 999, 9), (3, 5, 1), (2, 100, 10)], 1)]


def test_replay_dups_gaps(spark, tmp_path):
    log = files.read_changelog(spark, write(tmp_path / "c", LINES))
    assert tuple(replay.counts(replay.flags(log)).first()) == (2, 2, 4)
    assert states(replay.state(log)) == {"K#1": (15, 2, 3)}


def test_restore_replay_end_to_end(spark, tmp_path):
    base = str(tmp_path / "s")
    snap = spark.createDataFrame([("A#p1#100", 200, 2, 2), ("B#p2#100", 50, 1, 1)], S)
    files.advance(spark, snap, base, "sid", 1, 123)
    lines = [("A#p1#100", 2, 999, 9), ("A#p1#100", 3, 30, 3), ("B#p2#100", 1, 123, 1), ("B#p2#100", 2, 20, 2), ("C#p3#200", 1, 5, 1)]
    log = write(tmp_path / "c", [json.dumps({"key": k, "seq": s, "delta": d, "deltaQty": q, "ts": 1}) for k, s, d, q in lines])
    got = recovery.restore_and_replay(spark, base, log)
    assert (got.applied, got.skipped, got.next_offset) == (3, 1, 5) and got.bytes > 0
    assert states(got.state) == {"A#p1#100": (230, 5, 3), "B#p2#100": (70, 3, 2), "C#p3#200": (5, 1, 1)}
    name = recovery.snapshot_and_advance(spark, got, base, 1_700_000_000)
    assert name == "20231114T221320Z"
    again = recovery.restore_and_replay(spark, base, log)
    assert (again.applied, again.skipped) == (0, 0) and states(again.state) == states(got.state)


def test_missing_snapshot(spark, tmp_path):
    assert files.read_snapshot(spark, str(tmp_path), "").count() == files.read_snapshot(spark, str(tmp_path), "none").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, str(tmp_path), "none", 1)


def test_snapshot_and_manifest_roundtrip(spark, tmp_path):
    rows = [(f"k{i}", i, i, i) for i in range(5)]
    files.write_snapshot(spark, spark.createDataFrame(rows, S), str(tmp_path), "x", interchange=True)
    assert states(files.read_snapshot(spark, str(tmp_path), "x")) == {k: tuple(v) for k, *v in rows}
    assert states(files.read_interchange(spark, f"{tmp_path}/x/state.json")) == {k: tuple(v) for k, *v in rows}
    assert list(json.loads((tmp_path / "x/state.json").read_text())) == [f"k{i}" for i in range(5)]
    files.write_manifest(spark, str(tmp_path), "sid-123", 42, 7)
    assert files.read_manifest(spark, str(tmp_path)) == {"snapshotId": "sid-123", "lastChangelogOffset": 42, "createdAt": 7}


@pytest.mark.parametrize("line", ["{bad", "", LINES[0][:-1]])
def test_malformed_line_stops_replay(spark, tmp_path, line):
    with pytest.raises(files.MalformedRecord):
        files.read_changelog(spark, write(tmp_path / "c", [LINES[0], line, LINES[2]]))


def test_empty_changelog(spark, tmp_path):
    log = files.read_changelog(spark, write(tmp_path / "c", []))
    assert tuple(replay.counts(replay.flags(log)).first()) == (0, 0, -1) and replay.state(log).count() == 0


def test_changelog_append_keeps_order_within_files(spark, tmp_path):
    rows = [(f"k{i % 3}", i, i, 1, i) for i in range(300)]
    files.append_changelog(spark.createDataFrame(rows, "key string, seq bigint, delta bigint, deltaQty bigint, ts bigint").coalesce(1), str(tmp_path / "c"))
    got = files.read_changelog(spark, str(tmp_path / "c")).orderBy("pos").collect()
    assert [r.seq for r in got] == list(range(300)) and [r.pos for r in got] == list(range(1, 301))


def test_five_appends_keep_their_places(spark, tmp_path):
    path = str(tmp_path / "c")
    for k in range(5):
        rows = [("K", s, 1, 1, s) for s in range(10 * k + 1, 10 * k + 11)]
        files.append_changelog(spark.createDataFrame(rows, "key string, seq bigint, delta bigint, deltaQty bigint, ts bigint").repartition(3), path)
    for _ in range(2):
        log = files.read_changelog(spark, path)
        assert [(r.pos, r.seq) for r in log.orderBy("pos").collect()] == [(i, i) for i in range(1, 51)]
        assert states(replay.state(log)) == {"K": (50, 50, 50)} and log.agg({"bytes": "sum"}).first()[0] == sum(len(x) - 1 for f in (tmp_path / "c").glob("*/part-*") for x in f.open())
    files.append_changelog(log.where("pos > 40").drop("pos", "bytes"), path, epoch=4)  # again, as a repeated batch
    assert states(replay.state(files.read_changelog(spark, path))) == {"K": (50, 50, 50)}


def test_files_without_an_order_are_refused(spark, tmp_path):
    for k in range(2):
        spark.range(3).selectExpr("'K' as key", "id + 1 as seq", "id as delta").coalesce(1).write.mode("append").json(str(tmp_path / "c"))
    with pytest.raises(files.MalformedRecord):
        files.read_changelog(spark, str(tmp_path / "c"))


def test_topics_stand_in_for_files(spark, tmp_path):
    topics = {}

    def keep(name):
        def write(df):
            topics.setdefault(name, []).extend(map(tuple, df.collect()))
        return write

    deltas = spark.createDataFrame([("K", 1, 10, 1, 5), ("K", 1, 99, 9, 6), ("L", 2, 7, None, 7)], "key string, seq bigint, delta bigint, deltaQty bigint, ts bigint").coalesce(1)
    keep("changelog")(kafka.changelog_records(deltas))
    for k in (1, 2):
        files.advance(spark, spark.createDataFrame([], S), str(tmp_path), "sid", 0, k, [kafka.manifest_publisher(spark, keep("snapshots")), files.manifest_publisher(spark, str(tmp_path))])
    frame = lambda name: spark.createDataFrame([(0, i, k, v) for i, (k, v) in enumerate(topics[name])], "partition int, offset bigint, key string, value string")
    assert kafka.read_manifest(frame("snapshots")) == files.read_manifest(spark, str(tmp_path)) == {"snapshotId": "sid", "lastChangelogOffset": 0, "createdAt": 2}
    config = C.Recover(snapshot_dir=str(tmp_path), manifest_source="kafka", changelog_source="kafka", topic_snapshots="snapshots", topic_changelog="changelog", rounds=1)
    registry = jobs.recover(spark, config, frame)
    assert registry.get("opb_replay_applied_total") == 2 and registry.get("opb_replay_skipped_total") == 1 and registry.get("opb_changelog_lag") == 0
    assert registry.get("opb_replay_bytes_total") == sum(len(v) for _, v in topics["changelog"])
    with pytest.raises(LookupError):
        kafka.read_manifest(frame("changelog"))
    topics["snapshots"].append((kafka.MANIFEST_KEY, "{bad"))
    with pytest.raises(ValueError):
        kafka.read_manifest(frame("snapshots"))


def test_failing_publisher_stops_the_rest(spark, tmp_path):
    def fail(*_):
        raise OSError("no")

    with pytest.raises(OSError):
        files.advance(spark, spark.createDataFrame([], S), str(tmp_path), "sid", 0, 1, [fail, files.manifest_publisher(spark, str(tmp_path))])
    assert not files.exists(spark, f"{tmp_path}/{files.MANIFEST_FILE}")


def test_legacy_lines_without_quantity(spark, tmp_path):
    lines = ['{"key":"a","seq":1,"delta":10000,"ts":1}', '{"key":"a","seq":1,"delta":10000,"deltaQty":1,"ts":2}']
    assert states(replay.state(files.read_changelog(spark, write(tmp_path / "c", lines)))) == {"a": (10000, 0, 1)}

