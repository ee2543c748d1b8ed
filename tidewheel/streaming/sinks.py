"""Sinks of micro-batches: each may be repeated without harm."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Write = Callable[[DataFrame], None]


def fan_out(writes: Iterable[Write]) -> Callable[[DataFrame, int], None]:
    """Writers in order, each batch computed once; the first error stops the rest and the batch is repeated."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for write in writes:
                write(batch)
        finally:
            batch.unpersist()

    return each


def epochs(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch to its own folder, which a repeat of the batch overwrites: exactly one copy of each epoch's rows."""
    return lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_upserts(spark: SparkSession, path: str, keys: list[str], rank: list[str]) -> DataFrame:
    """Of the rows written by `epochs`, the last of each key: by `rank` (they are cumulative), then by epoch."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys and c != "epoch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*rank, "epoch")).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
