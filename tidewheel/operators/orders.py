"""Orders made ready for aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.keys import output_key, window_start

ORDER_COLUMNS = ["orderId", "productId", "price", "qty", "storeId", "ts"]


def normalize(orders: DataFrame) -> DataFrame:
    """Orders with validated = true and normTs = ts; any further column (an arrival position, say) stays."""
    return orders.withColumns({"validated": F.lit(True), "normTs": F.col("ts")})


def keyed(enriched: DataFrame, seconds: int | None = None) -> DataFrame:
    """Enriched orders with windowStart and key."""
    return enriched.withColumn("windowStart", window_start("normTs", seconds)).withColumn("key", output_key())


def validated_only(enriched: DataFrame, required: bool = True) -> DataFrame:
    """The contract's gate; aggregation doesn't ask for it unless told to."""
    return enriched.where("validated") if required else enriched


def passthrough(records: DataFrame) -> DataFrame:
    """Keys and values as they came."""
    return records.select("key", "value")
