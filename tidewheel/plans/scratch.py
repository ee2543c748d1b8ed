"""A folder that the driver and all executors share, for what a query writes on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new path within the folder the cluster names in spark.checkpoint.dir (or the context has). On one machine without either, a temporary one; on a cluster that raises."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (own.get() if own.isDefined() else None)
    master = spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
    return f"{(base or tempfile.mkdtemp(prefix='scratch-')).rstrip('/')}/{uuid.uuid4()}"
