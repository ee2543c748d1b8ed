"""Column functions of the order model: windows, keys, amounts, times. They serve batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.schemas import DEFAULT_WINDOW


def window_size(seconds: int | None) -> int:
    """A window's length; none, zero and negative ones mean the default."""
    return seconds if seconds and seconds > 0 else DEFAULT_WINDOW


def window_start(norm_ts: str | Column = "normTs", seconds: int | None = None) -> Column:
    """Start of the tumbling window, by division that truncates towards zero (before 1970 too)."""
    size = F.lit(window_size(seconds)).cast("bigint")
    ts = F.col(norm_ts) if isinstance(norm_ts, str) else norm_ts
    return (ts - ts % size).cast("bigint")


def output_key(store: str = "storeId", product: str = "productId", start: str = "windowStart") -> Column:
    """store#product#windowStart, for display and as the key of sinks; groups go by the three columns, as # is not escaped."""
    return F.concat_ws("#", F.coalesce(F.col(store), F.lit("")), F.coalesce(F.col(product), F.lit("")), F.col(start).cast("string"))


def amount(price: str = "price", qty: str = "qty") -> Column:
    """price * qty; an overflow raises under ANSI mode."""
    return F.col(price) * F.col(qty)


def clamp(value: Column) -> Column:
    """Never below zero."""
    return F.greatest(value, F.lit(0).cast("bigint"))


def snapshot_id(at: Column) -> Column:
    """Name of a snapshot taken at a time (epoch seconds), in UTC, free of signs that paths can't hold."""
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(at), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
