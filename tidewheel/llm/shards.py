"""Comparing the members of shards pair by pair: shards of any size, in tasks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import cut

#: Members of a shard that one group of a task compares with one another.
MAX_SHARD = 2048


def deal(members: DataFrame, identity: str, most: int = MAX_SHARD) -> DataFrame:
    """Members (with a column `shard` long) dealt into groups (shard, lo, hi), sorted so within partitions.

    A shard of up to `most` members is the group (0, 0). A larger one is cut into chunks
    by a hash of `identity`, and every pair of chunks is a group: the members of chunk c
    go to all groups with lo = c or hi = c. So each pair of members meets in exactly one
    group (those of the same chunk where lo = hi), and no group has many more than
    2 * `most` members. Shards of one member are left out.
    """
    sizes = cut(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most))
    kept = members.withColumns({"lo": F.lit(0), "hi": F.lit(0), "chunk": F.lit(0)})
    if sizes.limit(1).count():
        sized = members.join(sizes, "shard", "left").withColumn("of", F.coalesce(F.ceil(F.col("n") / most * 1.25), F.lit(1)).cast("int"))
        sized = sized.withColumn("chunk", F.pmod(F.xxhash64(identity, F.lit("chunk")), F.col("of").cast("bigint")).cast("int"))
        each = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
        kept = each.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("n", "of", "other")
    return kept.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups of a partition that `deal` has sorted: rows, and where each group starts and the last ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        starts = _starts(batch)
        last = int(starts[-1])
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)]), np.append(starts[:-1], last)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held), np.append(_starts(held[0]), held[0].num_rows)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    shard, lo, hi = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("shard", "lo", "hi"))
    new = (shard[1:] != shard[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links i - j reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
