"""Recovery: idempotent replay of a changelog over a snapshot, by sequence numbers.

A record applies if its sequence number is above its key's last. The last number after any
record is the running maximum of the numbers met (and the snapshot's), whether that record
applied or not; so the gate is a window function, and the state is a sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITION = "pos"


def flags(changelog: DataFrame, snapshot: DataFrame | None = None, from_offset: int = 0) -> DataFrame:
    """The changelog (pos, key, seq, delta, deltaQty, ...) after `from_offset`, with `applied`.

    `snapshot` (key, SumAmount, SumQty, LastSeq) sets where each key starts. Positions up
    to from_offset are neither applied nor skipped. A missing deltaQty is 0.
    """
    log = changelog.where(F.col(POSITION) > from_offset).withColumn("deltaQty", F.coalesce("deltaQty", F.lit(0).cast("bigint")))
    start = F.lit(0).cast("bigint")
    if snapshot is not None:
        log = log.join(snapshot.select("key", F.col("LastSeq").alias("_start")), "key", "left")
        start = F.coalesce("_start", start)
    before = F.max("seq").over(Window.partitionBy("key").orderBy(POSITION).rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("applied", F.col("seq") > F.greatest(start, F.coalesce(before, F.lit(0)))).select(*changelog.columns, "applied")


def state(changelog: DataFrame, snapshot: DataFrame | None = None, from_offset: int = 0) -> DataFrame:
    """(key, SumAmount, SumQty, LastSeq) after replay; keys of the snapshot without records stay."""
    done = flags(changelog, snapshot, from_offset).where("applied").groupBy("key").agg(F.sum("delta").cast("bigint").alias("a"), F.sum("deltaQty").cast("bigint").alias("q"), F.max("seq").alias("s"))
    if snapshot is None:
        return done.select("key", F.col("a").alias("SumAmount"), F.col("q").alias("SumQty"), F.col("s").alias("LastSeq"))
    zero = F.lit(0).cast("bigint")
    both = snapshot.select("key", "SumAmount", "SumQty", "LastSeq").join(done, "key", "full")
    return both.select("key", *[(F.coalesce(o, zero) + F.coalesce(n, zero)).alias(o) for o, n in (("SumAmount", "a"), ("SumQty", "q"))], F.coalesce("s", "LastSeq").alias("LastSeq"))


def counts(flagged: DataFrame) -> DataFrame:
    """One row: applied, skipped, lastOffset (the last record met, applied or not; -1 if none)."""
    n = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("bigint")
    return flagged.agg(n(F.col("applied")).alias("applied"), n(~F.col("applied")).alias("skipped"), F.coalesce(F.max(POSITION), F.lit(-1)).cast("bigint").alias("lastOffset"))


def summary(flagged: DataFrame) -> DataFrame:
    """One row: what `counts` tells, and bytes of all values read (column bytes), in one pass."""
    return flagged.agg(
        F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("skipped"),
        F.coalesce(F.max(POSITION), F.lit(-1)).cast("bigint").alias("lastOffset"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"),
    )


def value_bytes(records: DataFrame, value: str = "value") -> DataFrame:
    """One row: bytes of all values, of applied and skipped records."""
    return records.agg(F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).cast("bigint").alias("bytes"))


def get(states: DataFrame, key: str) -> DataFrame:
    return states.where(F.col("key") == key)


def scan(states: DataFrame) -> DataFrame:
    """All keys in order."""
    return states.orderBy("key")
