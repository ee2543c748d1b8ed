"""Latest record for each key, as a compacted topic keeps it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(records: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of each key with the highest position; aggregated before the shuffle."""
    rest = [c for c in records.columns if c not in keys]
    return records.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
