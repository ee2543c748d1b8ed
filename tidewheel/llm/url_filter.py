"""URL rules (allow or block a host with its subdomains, from a path on) by a sort-merge range join.

A key is the host's labels in reverse, a separator, and the path: `www.example.com/en/x`
has the key `com.example.www<sep>/en/x`. Cut after each label, a URL has one key for each
domain that it belongs to; a rule fits a URL if and only if the rule's key is a prefix of
the URL's key for the rule's host, that is, if that key lies in the interval of strings
which the rule's key starts. Rules and URL keys are sorted together over all partitions;
a sweep through each partition keeps a stack of the rules whose interval is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import cut, unused

SEPARATOR = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = "key string, kind int, host string, path string, verdict string"


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """`urls` with host and path (both empty where the URL is null or has no ://)."""
    inner, raw = unused(urls, "rest", "raw")
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(F.col(url)))).otherwise(F.lit(""))
    tail = F.substring(F.col(inner), F.length(raw) + 1, F.length(inner))
    split = urls.withColumn(inner, rest).withColumn(raw, F.regexp_extract(F.col(inner), r"^[^/?#]*", 0))
    return split.withColumns({"host": F.translate(raw, _UPPER, _LOWER), "path": F.regexp_extract(tail, r"^[^?#]*", 0)}).drop(inner, raw)


def _labels(host):
    return F.reverse(F.split(host, r"\."))


def _sweep(batches: Iterator[pa.RecordBatch], opened: dict[int, list[tuple[str, str, str]]]) -> Iterator[pa.RecordBatch]:
    """Best rule for each URL key of a sorted partition. opened: by partition, the rules open where it starts, outermost first."""
    stack: list[tuple[str, str, str]] | None = None
    for batch in batches:
        rows = batch.to_pydict()
        out: dict[str, list] = {"host": [], "path": [], "rule": [], "verdict": []}
        for part, key, kind, host, path, verdict in zip(*(rows[c] for c in ("part", "key", "kind", "host", "path", "verdict"))):
            if stack is None:
                stack = list(opened.get(part, ()))
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, host + path, verdict))
            elif stack:
                for name, value in zip(out, (host, path, *stack[-1][1:])):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in out.items()})


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """`urls` with host, path, rule and verdict; `rules` has host, path, verdict.

    The longest rule that fits wins (by its characters; of two rules alike, block); without
    one, rule is null and the verdict `default`. A null URL, or one without ://, has empty
    host and path, and so no rule. Rows stay as often as they are; columns of `urls` named
    like the new ones are replaced. No rules or no URLs: nothing special.

    The range partitioning is by (key, host, path) of the distinct (host, path) pairs, so
    one frequent URL is one key, and a frequent host or prefix is split over partitions;
    the rows of a frequent URL meet their verdict in a join whose large partitions AQE splits.
    A partition can start inside intervals that earlier ones opened: those rules are the
    prefixes of its first key, found by an equi-join of at most one key a partition. They
    (partitions x depth of nesting) are all that reaches the driver.
    """
    spark = urls.sparkSession
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where("host is not null and path is not null").distinct()
    rules = cut(rules.select(F.concat(F.array_join(_labels("host"), "."), F.lit(SEPARATOR), "path").alias("key"), F.lit(0).alias("kind"), "host", "path", "verdict"))
    size = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    depth, length = size[0] or 0, size[1] or 0
    split = parts(urls.drop("host", "path", "rule", "verdict"), url)
    pairs = split.select("host", "path").where("host <> ''").distinct()
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(max(depth, 1)))), lambda i: F.array_join(F.slice(_labels("host"), F.lit(1), i), "."))
    keys = pairs.select(F.explode(levels).alias("level"), "host", "path")
    # No rule's path is longer than `length`: beyond it, a key's order relative to rules is settled.
    keys = keys.select(F.concat("level", F.lit(SEPARATOR), F.substring("path", 1, length)).alias("key"), F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"))
    line = rules.union(keys).repartitionByRange("key", "kind", "host", "path").sortWithinPartitions("key", "kind", "verdict")
    line = cut(line).withColumn("part", F.spark_partition_id())
    first = line.groupBy("part").agg(F.min("key").alias("first"))
    heads = first.select("part", F.explode(F.sequence(F.lit(1), F.length("first"))).alias("n"), "first").select("part", F.substring("first", F.lit(1), F.col("n")).alias("key"))
    opened: dict[int, list[tuple[str, str, str]]] = {}
    for r in sorted(heads.join(rules, "key").select("part", "key", F.concat("host", "path").alias("rule"), "verdict").collect(), key=lambda r: (r.part, len(r.key), r.verdict)):
        opened.setdefault(r.part, []).append((r.key, r.rule, r.verdict))
    hits = line.mapInArrow(lambda it: _sweep(it, opened), "host string, path string, rule string, verdict string")
    (inner,) = unused(split, "best")
    # Cut, so that both sides of the join are plain shuffles and AQE can split the rows of a very common URL.
    best = cut(hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias(inner)))
    found = split.join(best, ["host", "path"], "left")
    kept = [c for c in split.columns if c not in ("host", "path")]
    return found.select(*kept, "host", "path", F.col(f"{inner}.rule").alias("rule"), F.coalesce(F.col(f"{inner}.verdict"), F.lit(default)).alias("verdict"))


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) given as a list."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
