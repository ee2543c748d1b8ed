"""Near-duplicate embeddings by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random and keeps the signs of its coordinates, a vertex of the
cube, and a factor: its inner product with that vertex. From the vertex's product with
another rotated vector, divided by the factor, comes an unbiased estimate of the two
vectors' cosine c, whose error is at most CONFIDENCE * sqrt(1 - c * c) times a width that the
factor gives. Only pairs for which the bound admits the threshold are computed exactly.
Signs of further rotations make the keys of several tables; pairs that share none of them
are not met. To the tables go codes, factors and the rotated coordinates in a byte each (whose
rounding widens the bound); whole vectors follow only for members that have an admitted
pair there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.llm.common import cut
from tidewheel.llm.components import classes
from tidewheel.llm.shards import deal, groups, roots

CONFIDENCE = 5.0
#: Vectors of a shard, about, and the share of pairs at the threshold that may miss every table.
AIM, MISS = 1024, 1e-4


def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same for each dimension and number everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(vectors: int, threshold: float, aim: int = AIM, miss: float = MISS) -> tuple[int, int]:
    """(signs of a key, tables) for a class of so many vectors."""
    alike = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(1, vectors / aim))))
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-(alike**bits))))


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _code(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """Adds to rows (the last column the vector): code, factor, turned (coordinates in steps of span), span, the tables' keys, and the same in 4 bytes each."""
    known: dict[tuple[int, int], np.ndarray] = {}

    def turn(dim: int, number: int) -> np.ndarray:
        if (dim, number) not in known:
            known[dim, number] = rotation(dim, number)
        return known[dim, number]

    for batch in batches:
        vec = batch.column(batch.num_columns - 1)
        sizes = vec.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
            unit = _unit(part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
            first = unit @ turn(dim, 0)
            factor = np.abs(first).sum(axis=1) / math.sqrt(dim)
            span = np.abs(first).max(axis=1) / 127
            turned = np.rint(first / span[:, None]).astype(np.int8)
            code = np.packbits(first > 0, axis=1)
            need = -(-bits * tables // dim)
            signs = np.concatenate([first > 0] + [unit @ turn(dim, r) > 0 for r in range(1, need)], axis=1)[:, : bits * tables].reshape(len(unit), tables, bits)
            keys = (signs << np.arange(bits)).sum(axis=2).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (code, turned, keys.astype(np.uint32))), pa.array(factor), pa.array(span), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.ravel()))],
                names=[*batch.schema.names, "code", "turned", "own", "factor", "span", "keys"],
            )


class _Codes:
    """The codes of a task's groups, and which pairs of members the bound admits."""

    def __init__(self, rows: pa.Table, threshold: float):
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        self.column, self.threshold = column, threshold
        self.lo, self.hi, self.chunk, self.table = (column[c].to_numpy(zero_copy_only=False) for c in ("lo", "hi", "chunk", "table"))

    def _bytes(self, name: str, start: int, end: int, kind) -> np.ndarray:
        return np.frombuffer(b"".join(self.column[name].slice(start, end - start).to_pylist()), kind).reshape(end - start, -1)

    def admitted(self, start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (from the group's start) for which the bound admits the threshold, and that share no earlier table's key."""
        number = end - start
        turned = self._bytes("turned", start, end, np.int8)
        own = self._bytes("own", start, end, np.uint32)
        dim, table = turned.shape[1], int(self.table[start])
        signs = np.unpackbits(self._bytes("code", start, end, np.uint8), axis=1, count=dim).astype(np.float32) * 2 - 1
        factor, span = (self.column[c].slice(start, number).to_numpy(zero_copy_only=False) for c in ("factor", "span"))
        seen = turned.astype(np.float32) * (span / math.sqrt(dim))[:, None].astype(np.float32)
        width = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1))
        floor = ((self.threshold - CONFIDENCE * math.sqrt(1 - self.threshold**2) * width) * factor - 1e-5).astype(np.float32)
        off = (span * math.sqrt(dim) / 2).astype(np.float32)  # what rounding to steps can take away
        here = np.arange(number)
        same = self.lo[start] == self.hi[start]
        c = self.chunk[start:end]
        a, b = (here, here) if same else (here[c == self.lo[start]], here[c == self.hi[start]])
        for at in range(0, len(a) if len(b) else 0, 512):
            x = a[at : at + 512]
            i, j = np.nonzero(seen[x] @ signs[b].T + off[x, None] >= floor[b][None, :])
            i, j = x[i], b[j]
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 200_000):
                m, n = i[k : k + 200_000], j[k : k + 200_000]
                fresh = ~(own[m, :table] == own[n, :table]).any(axis=1) if table else np.ones(len(m), bool)
                yield m[fresh], n[fresh]


def _met(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The members of each group that have an admitted pair there."""
    for rows, bounds in groups(batches):
        codes = _Codes(rows, threshold)
        has = np.zeros(rows.num_rows, bool)
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - start > 1:
                for i, j in codes.admitted(start, end):
                    has[start + i] = has[start + j] = True
        yield from rows.select(["shard", "lo", "hi", "chunk", "table", "node"]).filter(pa.array(has)).combine_chunks().to_batches()


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(node, root, links): what each member of a group links to by exact cosines, counted in the first table that a pair shares."""
    for rows, bounds in groups(batches):
        codes = _Codes(rows, threshold)
        node, copies, label = (codes.column[c].to_numpy(zero_copy_only=False) for c in ("node", "copies", "label"))
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            number, weight, kind, name = end - start, copies[start:end], label[start:end], node[start:end]
            unit = _unit(codes.column["vec"].slice(start, number).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(number, -1))
            links, root = np.zeros(number), np.arange(number)
            for i, j in codes.admitted(start, end):
                close = (np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold) & (kind[i] == kind[j])
                i, j = i[close], j[close]
                links += np.bincount(i, weight[j], minlength=number) + np.bincount(j, weight[i], minlength=number)
                root = roots(number, np.concatenate([i, np.arange(number)]), np.concatenate([j, root]))
            tell = np.flatnonzero((links > 0) | (root != np.arange(number)))
            yield pa.RecordBatch.from_arrays([pa.array(name[tell]), pa.array(name[root[tell]]), pa.array(links[tell].astype(np.int64))], names=["node", "root", "links"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label, ...).

    Two vectors link if their labels are equal and not null, their lengths are equal and
    their cosine in double precision is at least the threshold; those that are null, empty,
    zero, or hold a null or non-finite component, and those without label, link with
    nothing and are their own component. n_links counts other rows. Of all pairs at the
    threshold about one in ten thousand shares no table's key and is missed (fewer above
    it); none below it links. Rows with a null vec_id link with nothing and have a null
    component. Repeated rows are vectors of their own with the same id. Other columns are
    ignored; no rows give no rows.

    Equal vectors of a label are one node with a number of copies, so a frequent vector is
    one member of each shard; large shards are split in `deal`. Tables and keys follow the
    largest label's number of distinct vectors, the only thing that reaches the driver. A
    member of a table has about two bytes for each dimension and four for each table.
    """
    real = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint"), "embedding", F.col("label").cast("bigint"))
    rows = rows.withColumn("able", F.coalesce(real & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)))
    keyed = rows.withColumns({"k1": F.xxhash64("label", "embedding"), "k2": F.xxhash64(F.lit(1), "label", "embedding")})
    distinct = keyed.where("able").groupBy("label", "k1", "k2", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    most = distinct.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan(most, threshold)
    shape = distinct.select(F.monotonically_increasing_id().alias("node"), "label", "k1", "k2", "least", "copies", F.col("embedding").alias("vec"))
    kind = T.StructType([*shape.schema.fields, *(T.StructField(c, T.BinaryType()) for c in ("code", "turned", "own")), T.StructField("factor", T.DoubleType()), T.StructField("span", T.DoubleType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    coded = cut(shape.mapInArrow(lambda it: _code(it, bits, tables), kind))  # written, so that a node keeps its number
    met = coded.select("label", "node", F.size("vec").alias("dim"), "code", "turned", "own", "factor", "span", F.posexplode("keys").alias("table", "key"))
    members = met.withColumn("shard", F.xxhash64("label", "table", "dim", "key")).drop("label", "key", "dim")
    carried = ["code", "turned", "own", "factor", "span"]
    group = ["shard", "lo", "hi", "chunk", "table", "node"]
    some = deal(members, "node").select(*group, *carried).mapInArrow(lambda it: _met(it, threshold), "shard bigint, lo int, hi int, chunk int, table int, node bigint")
    again = cut(some).join(coded.select("node", "label", "copies", "vec", *carried), "node").repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")
    found = cut(again.select(*group, "label", "copies", "vec", *carried).mapInArrow(lambda it: _compare(it, threshold), "node bigint, root bigint, links bigint"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = coded.select("node", "least", "k1", "k2", "copies")
    known = classes(nodes, found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))).join(linked, "node", "left")
    known = cut(known.select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("least").alias("component")))
    out = keyed.select("vec_id", "able", F.when(F.col("able"), F.col("k1")).alias("k1"), F.when(F.col("able"), F.col("k2")).alias("k2")).join(known, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
