"""How far consumers are behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.keys import clamp


def partition_lag(heads: DataFrame, positions: DataFrame) -> DataFrame:
    """(partition, lag) from (partition, head) and (partition, position): records not yet read, never negative."""
    met = heads.join(positions, "partition", "left")
    return met.select("partition", clamp(F.col("head") + 1 - F.coalesce("position", F.lit(0))).cast("bigint").alias("lag"))
