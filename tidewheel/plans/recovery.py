"""Recovery end to end: manifest, snapshot, changelog, state, and the next manifest."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.keys import snapshot_id
from tidewheel.operators import replay
from tidewheel.sources import files


@dataclass(frozen=True)
class Result:
    """A recovery's state and its counts; next_offset is the changelog position after which to read on."""

    state: DataFrame
    applied: int
    skipped: int
    bytes: int
    next_offset: int
    seconds: float
    manifest: dict


def restore_and_replay(spark: SparkSession, base: str, changelog: str | DataFrame, manifest: dict | None = None) -> Result:
    """The state after the manifest's snapshot and the changelog beyond its offset.

    `changelog` is a path, or the records of a topic as `kafka.placed_changelog` gives
    them. One pass over the log finds malformed records, which raise before anything is
    applied, and the counts, which are all that reaches the driver; the state is a plan.
    """
    began = time.time()
    manifest = manifest or files.read_manifest(spark, base)
    offset = int(manifest["lastChangelogOffset"])
    snapshot = files.read_snapshot(spark, base, manifest["snapshotId"], offset)
    placed = files.placed_changelog(spark, changelog) if isinstance(changelog, str) else changelog
    flagged = replay.flags(placed, snapshot, offset)
    bad = placed.where("_bad").agg(F.min("pos").alias("malformed"))
    counted = replay.summary(flagged.where(~F.col("_bad"))).join(bad).first()  # a row each
    if counted.malformed is not None:
        raise files.MalformedRecord(f"record {counted.malformed} of the changelog is malformed")
    state = replay.state(placed.where(~F.col("_bad")).drop("_bad", "bytes"), snapshot, offset)
    return Result(state, counted.applied, counted.skipped, counted.bytes, max(offset, counted.lastOffset), time.time() - began, manifest)


def snapshot_and_advance(spark: SparkSession, result: Result, base: str, now: int | None = None, publish: Iterable[Callable[[str, int, int], None]] | None = None) -> str:
    """Writes the recovered state as a new snapshot, and then the manifest with its offset; the snapshot's name."""
    at = int(now if now is not None else time.time())
    name = spark.range(1).select(snapshot_id(F.lit(at)).alias("n")).first().n
    files.advance(spark, result.state, base, name, result.next_offset, at, publish)
    return name
