"""Seeded generators of orders: a bounded table, and a stream at a rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Three orders for trials, in one window.
SAMPLE = [("o1", "p1", 10000, 1, "A", 1694500000), ("o2", "p1", 10000, 2, "A", 1694500010), ("o3", "p2", 5000, 3, "A", 1694500020)]


def sample_orders(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SAMPLE, "orderId string, productId string, price bigint, qty bigint, storeId string, ts bigint")
    return rows.withColumns({"validated": F.lit(True), "normTs": F.col("ts")})


def gen_orders(spark: SparkSession, count: int = 100, base: int = 1694500000, seed: int = 42) -> DataFrame:
    """Enriched orders: products p1 to p5, prices 1000 to 9999, quantities 1 to 5, stores A to C, one every ten seconds."""

    def pick(low: int, high: int, salt: int):
        return (F.lit(low) + F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(high - low + 1))).cast("bigint")

    ids = spark.range(count)
    ts = F.lit(base) + F.col("id") * 10
    return ids.select(
        F.concat(F.lit("o"), F.col("id").cast("string")).alias("orderId"), F.concat(F.lit("p"), pick(1, 5, 1).cast("string")).alias("productId"), pick(1000, 9999, 2).alias("price"),
        pick(1, 5, 3).alias("qty"), F.element_at(F.array(*map(F.lit, "ABC")), pick(1, 3, 4).cast("int")).alias("storeId"), ts.alias("ts"), F.lit(True).alias("validated"), ts.alias("normTs"),
    )


def load_stream(spark: SparkSession, rows_per_second: int, stores: int = 4, products: int = 999_999, seed: int = 42) -> DataFrame:
    """A stream of enriched orders for load tests: price 10000, quantity 1, ts the time of the row."""
    raw = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    ts = F.unix_timestamp("timestamp")
    return raw.select(
        F.concat(F.lit("o"), F.col("value").cast("string")).alias("orderId"), F.concat(F.lit("p"), (F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(products)) + 1).cast("string")).alias("productId"),
        F.lit(10000).cast("bigint").alias("price"), F.lit(1).cast("bigint").alias("qty"), F.chr(F.lit(65) + F.pmod("value", F.lit(stores))).alias("storeId"), ts.alias("ts"), F.lit(True).alias("validated"), ts.alias("normTs"),
    )
