"""Mixing sources to target weights by proportionally fair (Pfair) scheduling, in DataFrame operations only.

Each source's documents are put in blocks of about equal size. With whole shares a of a
period L, the k-th block of a source (from 1) is released at time floor((k - 1) * L / a)
and due at ceil(k * L / a); earliest deadline first gives each unit of time to a released
block. As the shares add up to L, every deadline is met, so that a source's blocks never
lag or lead its share of the time gone by a whole block, and the schedule repeats after L:
it is worked out once for a period, and every block finds its time by arithmetic. Where a
source has run out, its times stay empty, and the others go on in their proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import cut, small_side, unused

#: Units of a period, about (each source has one at least).
PERIOD = 200
#: Documents of a bucket, about, within which a running sum is taken in one task.
BUCKET = 512
BLOCK_BYTES = 65536
#: An id that more than one of so many documents has is dealt to several buckets; so there are at most so many such ids.
HEAVY = 100_000


def shares(docs: DataFrame, power: float = 0.5, period: int = PERIOD) -> DataFrame:
    """(source, share): whole shares of a period in proportion to each source's bytes to a power, one at least."""
    return _shares(docs.select("source", F.octet_length("text").alias("bytes")), power, period)


def _shares(rows: DataFrame, power: float, period: int = PERIOD) -> DataFrame:
    """The same from (source, bytes) of each document."""
    sizes = rows.groupBy("source").agg(F.sum("bytes").cast("double").alias("bytes"))
    weight = F.pow(F.coalesce("bytes", F.lit(0.0)) + 1, F.lit(power))
    total = Window.partitionBy(F.lit(1))  # over a row for each source
    return sizes.withColumn("w", weight).select("source", F.greatest(F.lit(1), F.round(F.col("w") / F.sum("w").over(total) * period)).cast("int").alias("share"))


def timetable(weights: DataFrame) -> DataFrame:
    """(source, share, period, nth, release, deadline, time): one period's schedule, nth from 0.

    `weights` has source and share (whole; others than positive are left out). Of blocks
    with the same deadline the one of the source with the larger share goes first, then of
    the first by name (null first).

    A source with a share of one has the whole period for its block and the last of all
    deadlines, and is the last among those that share it. So earliest-deadline-first is
    run, as a fold over the blocks, for the sources with larger shares alone, and those of
    one take the times left over, in order, by arithmetic: any number of sources will do.
    The fold's work is the product of the number of sources with larger shares and their
    blocks in a period (with `shares` at most about PERIOD each).
    """
    known = weights.where("share > 0").select("source", F.col("share").cast("bigint").alias("share"))
    size = known.agg(F.sum("share").alias("period"))
    larger = known.where("share > 1")
    one = larger.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("o"), "source", "share"))).alias("s"), F.coalesce(F.sum("share"), F.lit(0)).alias("jobs"))
    one = one.crossJoin(F.broadcast(size)).where("period is not null")  # a row each
    # The fold's state: the time, how many blocks of each source are done, and who has had which time. At each step the
    # due block that is released goes; where none is, time moves on to the next release (and sources of one fill the gap).
    step = """
        aggregate(if(jobs > 0, sequence(1L, jobs), cast(array() as array<bigint>)),
          named_struct('t', 0L, 'done', transform(s, x -> 0L), 'who', cast(array() as array<struct<t: bigint, i: int>>)),
          (acc, _) -> aggregate(array(greatest(acc.t, array_min(filter(transform(s, (x, i) -> if(acc.done[i] < x.share, (acc.done[i] * period) div x.share, null)), y -> y is not null)))),
             acc,
             (a, t) -> aggregate(array(
                 array_min(filter(transform(s, (x, i) -> named_struct(
                     'due', ((a.done[i] + 1) * period + x.share - 1) div x.share, 'i', i,
                     'ok', (a.done[i] * period) div x.share <= t and a.done[i] < x.share)), y -> y.ok)).i),
                 a,
                 (b, w) -> named_struct('t', t + 1, 'done', transform(b.done, (d, i) -> if(i = w, d + 1, d)), 'who', array_append(b.who, named_struct('t', t, 'i', w))))),
          acc -> acc.who)
    """
    folded = one.withColumn("who", F.expr(step)).select("period", "s", "who")
    times = folded.select("period", "s", F.explode("who").alias("w")).select("period", F.col("w.t").alias("time"), F.get("s", F.col("w.i")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("time")) - 1
    larger_times = times.select("period", "time", F.col("x.source").alias("source"), F.col("x.share").alias("share")).withColumn("nth", nth)
    # The r-th time that is free: r and the busy times before it. Ranks over a row for each source.
    free = known.where("share = 1").withColumn("r", F.row_number().over(Window.orderBy(F.asc_nulls_first("source"))).cast("bigint") - 1)
    busy = folded.select("period", F.transform("who", lambda w, j: w.getField("t") - j).alias("busy"))
    single_times = free.crossJoin(F.broadcast(busy)).select("period", (F.col("r") + F.size(F.filter("busy", lambda b: b <= F.col("r")))).alias("time"), "source", "share", F.lit(0).alias("nth"))
    both = larger_times.union(single_times)
    return both.select("source", "share", "period", "nth", F.expr("(nth * period) div share").alias("release"), F.expr("((nth + 1) * period + share - 1) div share").alias("deadline"), "time")


def _thin(docs: DataFrame) -> DataFrame:
    """(doc_id, source, bytes, row): what weights and blocks are worked out from, written once so that docs are read twice in all."""
    return cut(docs.select("doc_id", "source", F.octet_length("text").alias("bytes"), F.monotonically_increasing_id().alias("row")))


def _blocks(docs: DataFrame, thin: DataFrame, block_bytes: int, bucket: int, hash_: str, block: str) -> DataFrame:
    """docs with a hash of the id and the block (bigint, from 0): each source's documents in the order of that hash, cut by bytes.

    A document starts in the block in which the bytes of those before it end. Running sums
    go by buckets of hashes, about `bucket` documents each whatever the source's size, and
    over the buckets' sums. Documents of an id (or without one) that more than one document
    in HEAVY has are dealt to parts of about `bucket` each by their place in the input, and
    come after the others of their bucket.
    """
    size, key, part, of, before, inner, kind, count, row = unused(docs, "size", "key", "part", "buckets", "before", "inner", "kind", "count", "row")
    total = thin.count()
    often = thin.groupBy(F.col("doc_id").alias(kind)).agg(F.count("*").alias(count)).where((F.col(count) > 8 * bucket) & (F.col(count) * HEAVY > total))
    # At most HEAVY ids can be more than a share of one in HEAVY: a broadcast of known size.
    often = F.broadcast(cut(often.select(kind, F.ceil(F.col(count) / bucket).cast("bigint").alias(count))))
    keyed = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))  # never null, so that joins and windows by it share a shuffle
    sources = thin.groupBy(keyed.alias(key)).agg(F.count("*").alias(count))
    sources = small_side(cut(sources.select(key, F.greatest(F.lit(1), F.ceil(F.col(count) / bucket)).cast("bigint").alias(of))))

    def dealt(rows: DataFrame, length) -> DataFrame:
        """rows with key, bucket and part; a source's buckets are equal ranges of the hash's first 32 bits."""
        out = rows.withColumns({hash_: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), size: F.coalesce(length, F.lit(0)).cast("bigint") + 1, key: keyed})
        out = out.join(often, F.col("doc_id").eqNullSafe(F.col(kind)), "left")
        place = F.pmod(F.xxhash64(row), F.col(count))
        out = out.withColumn(part, F.when(F.col(count).isNull(), F.lit("")).otherwise(F.concat(hash_, F.lpad(place.cast("string"), 12, "0")))).drop(kind, count)
        first = F.conv(F.substring(hash_, 1, 8), 16, 10).cast("bigint")
        return out.join(sources, key).withColumn(kind, F.shiftright(first * F.col(of), 32)).drop(of)

    sums = dealt(thin.withColumnRenamed("row", row), F.col("bytes")).groupBy(key, kind, part).agg(F.sum(size).alias("b"))
    starts = cut(sums.select(key, kind, part, (F.sum("b").over(Window.partitionBy(key).orderBy(kind, part)) - F.col("b")).alias(before)))
    upto = Window.partitionBy(key, kind, part).orderBy(hash_, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt(docs.withColumn(row, F.monotonically_increasing_id()), F.octet_length("text")).withColumn(inner, F.sum(size).over(upto) - F.col(size))
    placed = placed.join(starts, [key, kind, part])
    return placed.withColumn(block, F.expr(f"(`{before}` + `{inner}`) div {block_bytes}")).select(*docs.columns, hash_, block)


def _mixed(docs: DataFrame, weights: DataFrame | None, block_bytes: int, bucket: int, power: float) -> tuple[DataFrame, str]:
    """docs with block, release, deadline, slot and the hash that orders the rows of a slot; the hash's name."""
    plain = docs.drop("block", "release", "deadline", "slot")
    hash_, block, name, place, share, period, release, deadline, time, whole, nth = unused(plain, "hash", "of", "name", "place", "share", "period", "released", "due", "time", "round", "nth")
    thin = _thin(plain)
    plan = cut(timetable(weights if weights is not None else _shares(thin, power)))
    plan = plan.select(F.col("source").alias(name), F.col("nth").cast("bigint").alias(nth), F.col("share").alias(share), F.col("period").alias(period), F.col("release").alias(release), F.col("deadline").alias(deadline), F.col("time").alias(time))
    ratio = plan.where(F.col(nth) == 0).select(name, share)
    met = _blocks(plain, thin, block_bytes, bucket, hash_, block).join(small_side(ratio), F.col("source").eqNullSafe(F.col(name)), "left").drop(name)
    met = met.withColumns({whole: F.expr(f"`{block}` div `{share}`"), place: F.expr(f"`{block}` % `{share}`")})
    # A row for each unit of the period.
    met = met.join(small_side(plan.drop(share)), F.col("source").eqNullSafe(F.col(name)) & (F.col(place) == F.col(nth)), "left")
    base = F.col(whole) * F.col(period)
    out = met.withColumns({"block": F.col(block), "release": base + F.col(release), "deadline": base + F.col(deadline), "slot": base + F.col(time)})
    return out.select(*plain.columns, "block", "release", "deadline", "slot", hash_), hash_


def mix(docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET, power: float = 0.5) -> DataFrame:
    """docs with block, release, deadline and slot (all bigint); sorted by slot, the rows are mixed.

    `weights` (source, share: whole parts of the period that they add up to) are the
    targets; without them, `shares` of docs. A source that has no weight comes after all
    others (slot null). Within a source, documents go by md5 of their id as text (a null id
    as an empty text), then by id; those of one id in any order, and of an id that very
    many documents have after the others of their bucket (see `_blocks`). No row is dropped
    or repeated: a source that runs out leaves its slots empty. Null texts weigh as empty
    ones; null ids and a null source are values like others. Columns of docs named like
    the new ones are replaced, all others pass. docs are read twice and should be a table,
    or cut, if very many documents share an id: those are dealt by their places. Any number of sources: their rows are
    broadcast up to a counted size, and joined by a shuffle beyond it.
    """
    out, hash_ = _mixed(docs, weights, block_bytes, bucket, power)
    return out.drop(hash_)


def mixed(docs: DataFrame, weights: DataFrame | None = None, block_bytes: int = BLOCK_BYTES, bucket: int = BUCKET, power: float = 0.5) -> DataFrame:
    """docs in mixed order: partitions are ranges of slots, each sorted by slot, hash and id; the columns of docs."""
    out, hash_ = _mixed(docs, weights, block_bytes, bucket, power)
    order = (F.asc_nulls_last("slot"), hash_, "doc_id")
    plain = out.repartitionByRange(*order).sortWithinPartitions(*order)
    clash = {"block", "release", "deadline", "slot"} & set(docs.columns)
    return plain.select(*docs.columns) if not clash else _with_own(docs, clash, weights, block_bytes, bucket, power)


def _with_own(docs: DataFrame, clash: set[str], weights: DataFrame | None, block_bytes: int, bucket: int, power: float) -> DataFrame:
    """`mixed` for docs that have columns of the schedule's names, which are kept under others meanwhile."""
    names = dict(zip(sorted(clash), unused(docs, *(f"own_{c}" for c in sorted(clash)))))
    out = mixed(docs.withColumnsRenamed(names), weights, block_bytes, bucket, power)
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
