"""JSON in and out: lenient decoding with zero values, encoding of records.

Differences left to JSON decoding by field name elsewhere: names are case-sensitive, text
after a complete record is accepted, numbers become strings where a string is asked for, and
a bare null is a malformed record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ZERO = {"string": "", "bigint": 0, "boolean": False}


def _zeroed(name: str, kind: str, record: str) -> Column:
    return F.coalesce(F.col(f"{record}.{name}"), F.lit(_ZERO[kind]).cast(kind)).alias(name)


def _fields(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in T.StructType.fromDDL(schema).fields]


def parsed(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """df with `_record` (zero values for fields missing or null) and `_bad` (true if the value is no such record)."""
    raw = F.from_json(F.col(value).cast("string"), f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    read = df.withColumn("_raw", raw)
    blank = F.coalesce(F.trim(F.col(value).cast("string")) == "", F.lit(True))
    bad = blank | F.col("_raw").isNull() | F.col("_raw._corrupt").isNotNull()
    record = F.struct(*[_zeroed(n, k, "_raw") for n, k in _fields(schema)])
    return read.withColumns({"_bad": bad, "_record": record}).drop("_raw")


def decode(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The records of df's values beside its other columns; malformed ones are left out, unknown fields ignored."""
    keep = [c for c in df.columns if c != value]
    names = [n for n, _ in _fields(schema)]
    return parsed(df, schema, value).where(~F.col("_bad")).select(*[c for c in keep if c not in names], *[F.col(f"_record.{n}").alias(n) for n in names])


def encode(columns: list[str]) -> Column:
    """A JSON object of columns; nulls are left out."""
    return F.to_json(F.struct(*columns))
