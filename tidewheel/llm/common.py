"""What the operators share: checkpoints in the shared folder, tables, packed keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


#: Rows up to which a small side of a join is broadcast; beyond, it is joined by a shuffle.
SMALL_SIDE = 200_000


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. On one machine without one, a temporary folder; on a cluster that raises, as executors would not see it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get(CHECKPOINT_KEY, None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"{CHECKPOINT_KEY} names no folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder's path within the shared checkpoint folder."""
    return f"{_shared(spark).rstrip('/')}/{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the reliable checkpoint folder that all executors share, and read from there."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that was written on the way."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for inner columns, none of which df has (case aside)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def small_side(df: DataFrame, rows: int = SMALL_SIDE) -> DataFrame:
    """df with the hint to broadcast it if it has at most `rows` rows, counted first; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """The rows no label of which may be learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
