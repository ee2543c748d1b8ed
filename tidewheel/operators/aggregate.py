"""Tumbling-window sums for each store and product: their end state, and the running outputs that lead there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.keys import amount
from tidewheel.operators.orders import keyed

GROUP = ["storeId", "productId", "windowStart"]


def final(enriched: DataFrame, seconds: int | None = None) -> DataFrame:
    """(key, storeId, productId, windowStart, sumAmount, sumQty, lastSeq): partial sums before one shuffle by the group."""
    sums = keyed(enriched, seconds).groupBy(*GROUP).agg(F.sum(amount()).cast("bigint").alias("sumAmount"), F.sum("qty").cast("bigint").alias("sumQty"), F.count("*").alias("lastSeq"), F.first("key").alias("key"))
    return sums.select("key", *GROUP, "sumAmount", "sumQty", "lastSeq")


def running(enriched: DataFrame, position: str, seconds: int | None = None, now: Column | None = None) -> DataFrame:
    """One output for each order, in the order of `position`: cumulative sums and the key's sequence number.

    Columns: position, key, storeId, productId, windowStart, seq, delta, deltaQty,
    sumAmount, sumQty, and updatedAt if `now` (epoch seconds) is given. A key is one
    window of one store and product, which bounds what a task sorts.
    """
    by = Window.partitionBy(*GROUP).orderBy(position)
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed(enriched, seconds).select(
        position, "key", *GROUP, F.row_number().over(by).cast("bigint").alias("seq"), amount().alias("delta"), F.col("qty").alias("deltaQty"),
        F.sum(amount()).over(upto).cast("bigint").alias("sumAmount"), F.sum("qty").over(upto).cast("bigint").alias("sumQty"),
    )
    return out if now is None else out.withColumn("updatedAt", now)


def deltas(outputs: DataFrame, now: Column | None = None) -> DataFrame:
    """Changelog records of running outputs."""
    out = outputs.select("key", "seq", "delta", "deltaQty")
    return out if now is None else out.withColumn("ts", now)


def batch_offsets(records: DataFrame, batch: Column, partition: Column, offset: str) -> DataFrame:
    """For each batch and partition the next offset to read."""
    return records.groupBy(batch.alias("batch"), partition.alias("partition")).agg((F.max(offset) + 1).alias("nextOffset"))
