"""Changelog, snapshot and manifest files, through Spark's readers only, so that any store it knows will do."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.codec import parsed
from tidewheel.operators.replay import scan
from tidewheel.schemas import DELTA, MANIFEST, SNAPSHOT, STATE

MANIFEST_FILE = "manifest.latest.json"


class MalformedRecord(ValueError):
    """A changelog, snapshot or manifest that can't be read."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


_PART = re.compile(r"(.*)/part-\d+-([0-9a-f-]{36})[^/]*$")


def _ordered(files: list[str], path: str) -> None:
    """Raises if a folder holds the files of several writes, whose names don't tell which came first."""
    writes: dict[str, str] = {}
    for f in files:
        if (m := _PART.match(f)) and writes.setdefault(m[1], m[2]) != m[2]:
            raise MalformedRecord(f"{path}: the files of several writes lie in {m[1]} without an order; `append_changelog` gives each a folder")


def placed_changelog(spark: SparkSession, path: str) -> DataFrame:
    """(pos, bytes, _bad, key, seq, delta, deltaQty, ts) of JSON lines, the malformed ones marked.

    pos is the 1-based place in the log. Places are counted within blocks of files, which
    are ordered by name and offset, so no task sees the whole log. The log is a file, or a
    folder of files named in order, or what `append_changelog` wrote; files of several
    writes side by side have no order and are refused. bytes: of the line as it is read.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    _ordered(lines.inputFiles(), path)
    lines = lines.select(F.col("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    blocks = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    placed = lines.join(F.broadcast(blocks.withColumn("before", before).drop("n")), ["f", "b"]).withColumn("pos", F.col("before") + F.col("i") - F.col("first") + 1)
    read = parsed(placed.select("pos", "value", F.octet_length("value").cast("bigint").alias("bytes")), DELTA)
    return read.select("pos", "bytes", "_bad", "_record.*")


def read_changelog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(pos, bytes, key, seq, delta, deltaQty, ts) of `placed_changelog`. A blank line is malformed; strict raises on a malformed line before anything is applied."""
    read = placed_changelog(spark, path)
    if strict and (bad := read.where("_bad").agg(F.min("pos").alias("pos")).first().pos):
        raise MalformedRecord(f"line {bad} of {path} is malformed")
    return read.where(~F.col("_bad")).drop("_bad")


def read_snapshot(spark: SparkSession, base: str, snapshot_id: str, offset: int = 0) -> DataFrame:
    """(key, SumAmount, SumQty, LastSeq) of a snapshot; no id: no rows.

    Its `state.parquet` is read, split as any table; one that has only the interchange file
    (`state.json`, from elsewhere) is one row of one task. A missing snapshot gives no
    rows, but raises if `offset` shows that records were left to it.
    """
    folder = f"{base}/{snapshot_id}"
    if snapshot_id and exists(spark, f"{folder}/state.parquet"):
        return spark.read.schema(STATE).parquet(f"{folder}/state.parquet")
    if not snapshot_id or not exists(spark, f"{folder}/state.json"):
        if snapshot_id and offset > 0:
            raise FileNotFoundError(f"snapshot {snapshot_id} is missing, and the changelog is to start after {offset}")
        return spark.createDataFrame([], STATE)
    return read_interchange(spark, f"{folder}/state.json")


def read_interchange(spark: SparkSession, path: str) -> DataFrame:
    """The state in a JSON object of keys."""
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", SNAPSHOT, {"mode": "FAILFAST"}).alias("m"))
    if read.where("m is null").limit(1).count():
        raise MalformedRecord(f"snapshot {path} is malformed")
    zero = F.lit(0).cast("bigint")
    return read.select(F.explode("m").alias("key", "s")).select("key", *[F.coalesce(f"s.{c}", zero).alias(c) for c in ("SumAmount", "SumQty", "LastSeq")])


def read_manifest(spark: SparkSession, base: str) -> dict:
    """The manifest {snapshotId, lastChangelogOffset, createdAt}."""
    path = f"{base}/{MANIFEST_FILE}"
    rows = parsed(spark.read.text(path, wholetext=True), MANIFEST).select("_bad", "_record").collect()  # one row
    if len(rows) != 1 or rows[0]._bad:
        raise MalformedRecord(f"manifest {path} is malformed")
    return rows[0]._record.asDict()


def write_text(spark: SparkSession, path: str, parts: str | Iterable[str]) -> None:
    """A file of text, written part by part beside its place and renamed into it."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    _, side = _fs(spark, f"{path}.{uuid.uuid4()}.tmp")
    out = fs.create(side, True)
    for part in [parts] if isinstance(parts, str) else parts:
        out.write(bytearray(part.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(side, p):
        raise OSError(f"could not rename {side.toString()} to {path}")


def write_manifest(spark: SparkSession, base: str, snapshot_id: str, offset: int, now: int) -> None:
    record = {"snapshotId": snapshot_id, "lastChangelogOffset": offset, "createdAt": now}
    write_text(spark, f"{base}/{MANIFEST_FILE}", json.dumps(record, indent=2))


def write_snapshot(spark: SparkSession, states: DataFrame, base: str, snapshot_id: str, interchange: bool = False) -> str:
    """A snapshot as Parquet (`state.parquet`, any size); with `interchange` also as one JSON object with its keys in order, which the driver passes on row by row."""
    folder = f"{base}/{snapshot_id}"
    states.select("key", "SumAmount", "SumQty", "LastSeq").write.mode("overwrite").parquet(f"{folder}/state.parquet")
    if interchange:
        rows = scan(spark.read.parquet(f"{folder}/state.parquet")).toLocalIterator()
        write_text(spark, f"{folder}/state.json", _object(rows))
    return folder


def _object(rows) -> Iterable[str]:
    start = "{"
    for r in rows:
        body = json.dumps({"SumAmount": r.SumAmount, "SumQty": r.SumQty, "LastSeq": r.LastSeq}, indent=2).replace("\n", "\n  ")
        yield f"{start}\n  {json.dumps(r.key, ensure_ascii=False)}: {body}"
        start = ","
    yield "{}" if start == "{" else "\n}"


def advance(spark: SparkSession, states: DataFrame, base: str, snapshot_id: str, offset: int, now: int, publish: Iterable[Callable[[str, int, int], None]] | None = None, interchange: bool = False) -> None:
    """A snapshot and then the manifests that point to it: the offset moves only together with the state it stands for.

    `publish`: publishers, called in order with (snapshot id, offset, time); the first
    error stops the rest. None: the manifest file beside the snapshots.
    """
    write_snapshot(spark, states, base, snapshot_id, interchange)
    for each in publish if publish is not None else [manifest_publisher(spark, base)]:
        each(snapshot_id, offset, now)


def manifest_publisher(spark: SparkSession, base: str) -> Callable[[str, int, int], None]:
    return lambda snapshot_id, offset, now: write_manifest(spark, base, snapshot_id, offset, now)


def next_epoch(spark: SparkSession, path: str) -> int:
    """One more than the last epoch of a changelog; 0 without one."""
    fs, p = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return max([int(n[6:]) for n in names if n.startswith("epoch-")], default=-1) + 1


def append_changelog(deltas: DataFrame, path: str, epoch: int | None = None, order: tuple[str, ...] = ("seq",)) -> None:
    """JSON lines in a folder of their own, after all earlier ones; a null deltaQty is left out.

    Folders are named by epoch, so that names are in order, and an epoch that is written
    again replaces itself: the same rows have the same places. None: one more than the
    last. Rows go by `order`, in which a key's sequence numbers must rise.
    """
    if epoch is None:
        epoch = next_epoch(deltas.sparkSession, path)
    rows = deltas.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("key", "seq", "delta", "deltaQty", "ts").write.mode("overwrite").json(f"{path}/epoch-{epoch:019d}")
