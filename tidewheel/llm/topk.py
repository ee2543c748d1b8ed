"""Exact top-k by inner product: columnar branch and bound over blocks of vectors.

Blocks hold vectors in vertical layout, a row for each dimension. A block of queries meets
a block of candidates dimension block by dimension block: partial products accumulate, and
the norms of what is left of both sides bound what the rest can add or take (Cauchy and
Schwarz). Candidates whose bound falls below every query's k-th best lower bound so far go,
and the survivors' columns are compacted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import cut
from tidewheel.llm.vectors import matrices

CANDIDATES, QUERIES, DIMENSIONS = 4096, 512, 16
#: Candidates of a group, which one worker holds at a time; small inputs make so many groups that all cores are busy.
GROUP, LEAST_GROUPS = 65536, 24
#: Groups that have been searched when a round ends, as a multiple of those when it began.
ROUND = 8
_BLOCK = "dim int, n int, key bigint, form string, ids binary, data binary"
_EXACT = float(2**53)
#: What a score can be; products beyond are given as these.
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


def _blocks(batches: Iterator[pa.RecordBatch], scale: float, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) gathered into blocks of up to `size` vectors of floor(scale * x), one dimension after the other.

    A block's numbers have the narrowest whole type that holds them (`form`). Vectors with
    one of 2 ** 53 or more go to blocks of their own (form raw), unscaled as they are.
    """
    held: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(of: tuple[int, bool], n: int) -> pa.RecordBatch:
        ids, rows = (np.concatenate([x[k] for x in held[of]]) for k in (0, 1))
        held[of] = [(ids[n:], rows[n:])]
        ids, rows = ids[:n], rows[:n]
        form = "f8" if of[1] else next(f for f in ("i1", "i2", "i4", "i8") if np.iinfo(f).min <= rows.min() and rows.max() <= np.iinfo(f).max)
        key = int(np.bitwise_xor.reduce(ids * 0x9E3779B1 + 7)) + len(ids)
        values = [pa.array([of[0]], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([key], pa.int64()), pa.array(["raw" if of[1] else form]), pa.array([ids.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays([*values, pa.array([np.ascontiguousarray(rows.T).astype(form).tobytes()], pa.binary())], names=["dim", "n", "key", "form", "ids", "data"])

    for batch in batches:
        ids = batch.column(0)
        for at, matrix in matrices(ids, batch.column(1)):
            with np.errstate(over="ignore"):
                floors = np.floor(matrix * scale)
            fits = (np.abs(floors) < _EXACT).all(axis=1)
            names = ids.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)
            for wide, rows, mine in ((False, floors, fits), (True, matrix, ~fits)):
                if not mine.any():
                    continue
                of = (matrix.shape[1], wide)
                held.setdefault(of, []).append((names[mine], rows[mine]))
                while sum(len(x[0]) for x in held[of]) >= size:
                    yield out(of, size)
    for of, parts in held.items():
        if n := sum(len(x[0]) for x in parts):
            yield out(of, n)


class _Block:
    """Vectors of a block, ids ascending: the vertical matrix, and norms of the dimensions from each block of them on; for raw ones whole numbers of any size."""

    def __init__(self, data: bytes, ids: bytes, dim: int, form: str, scale: float):
        names = np.frombuffer(ids, np.int64)
        order = np.argsort(names, kind="stable")
        self.ids, self.dim, self.raw = names[order], dim, form == "raw"
        matrix = np.frombuffer(data, "f8" if self.raw else form).reshape(dim, -1)[:, order]
        if self.raw:
            by = Fraction(scale)
            self.whole = np.array([math.floor(Fraction(x) * by) for x in matrix.ravel().tolist()], dtype=object).reshape(matrix.shape)
            return
        self.matrix = matrix.astype(np.float64)
        squares = np.add.reduceat(self.matrix**2, np.arange(0, dim, DIMENSIONS), axis=0)[::-1].cumsum(axis=0)[::-1]
        self.left = np.sqrt(np.concatenate([squares, np.zeros((1, matrix.shape[1]))])) * (1 + 1e-9)
        self.most = float(np.abs(self.matrix).max(initial=0))

    def numbers(self, at: np.ndarray) -> np.ndarray:
        """Whole numbers of the vectors at those places, a column for each."""
        return self.whole[:, at] if self.raw else self.matrix[:, at].astype(np.int64).astype(object)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def _candidates(q: _Block, c: _Block, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in q, places in c, scores) among which are the k best of c for each vector of q, or all that reach its bar."""
    n, dim = len(q.ids), q.dim
    if q.raw or c.raw:  # whole numbers of any size, all pairs
        i, j = np.nonzero(q.ids[:, None] != c.ids[None, :])
        score = (q.numbers(np.arange(n)).T @ c.numbers(np.arange(len(c.ids))))[i, j]
        return i, j, _clipped(score)
    exact = q.most * c.most * dim < _EXACT
    live, score = np.arange(len(c.ids)), np.zeros((n, len(c.ids)))
    own = np.isin(c.ids, q.ids)
    for step, at in enumerate(range(0, dim, DIMENSIONS)):
        part = c.matrix[at : at + DIMENSIONS]
        score += q.matrix[at : at + DIMENSIONS].T @ (part if len(live) == len(c.ids) else part[:, live])
        if at + DIMENSIONS >= dim:
            break
        spread = q.left[step + 1][:, None] * c.left[step + 1][live][None, :] + _rounding(q, c, live, exact)
        lower = score - spread
        if own[live].any():
            lower[q.ids[:, None] == c.ids[live][None, :]] = -np.inf
        floor = np.maximum(bar, _kth(lower, k))
        stays = (score + spread + 1 >= floor[:, None]).any(axis=0)
        if stays.sum() < 0.9 * len(live):
            live, score = live[stays], score[:, stays]
    off = _rounding(q, c, live, exact)
    lower = score - off
    if own[live].any():
        same = q.ids[:, None] == c.ids[live][None, :]
        lower[same] = score[same] = -np.inf
    i, j = np.nonzero((score + off >= np.maximum(bar, _kth(lower, k))[:, None]) & (score > -np.inf))
    if exact:
        return i, live[j], score[i, j].astype(np.int64)
    whole = [(q.numbers(i[a : a + 4096]) * c.numbers(live[j[a : a + 4096]])).sum(axis=0) for a in range(0, len(i), 4096)]
    return i, live[j], _clipped(np.concatenate(whole) if whole else np.zeros(0, object))


def _rounding(q: _Block, c: _Block, live: np.ndarray, exact: bool) -> np.ndarray | float:
    """How far sums of floats can lie from the products: nothing below 53 bits."""
    return 0.0 if exact else (q.dim + 8) * 2.0**-52 * q.left[0][:, None] * c.left[0][live][None, :]


def _clipped(score: np.ndarray) -> np.ndarray:
    return np.array([min(max(s, _LOWEST), _HIGHEST) for s in score.tolist()], dtype=np.int64)


def _lowered(score: np.ndarray) -> np.ndarray:
    """Not above the whole numbers that were rounded to these."""
    return np.where(np.isinf(score), score, score - np.abs(score) * 2.0**-52)


def _search(q: _Block, group: list[_Block], k: int, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores): the k best of a group of candidate blocks for each query of a block, if they reach the k-th best known by query id."""
    bar = _lowered(np.array([known.get(x, -np.inf) for x in q.ids.tolist()], dtype=np.float64))  # of each query: its k-th best so far
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # query's place, candidate, score
    for c in group:
        i, j, score = _candidates(q, c, bar, k)
        best = [np.concatenate([b, x]) for b, x in zip(best, (i, c.ids[j], score))]
        order = np.lexsort((best[1], ~best[2], best[0]))
        best = [b[order] for b in best]
        rank = np.arange(len(order)) - np.searchsorted(best[0], best[0])
        best = [b[rank < k] for b in best]
        last = np.flatnonzero(rank[rank < k] == k - 1)
        bar[best[0][last]] = np.maximum(bar[best[0][last]], _lowered(best[2][last].astype(np.float64)))
    return q.ids[best[0]], best[1], best[2]


def _run(batches: Iterator[pa.RecordBatch], k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """A partition sorted by group, its candidate blocks before its query blocks."""
    now, group = None, []
    for batch in batches:
        for r in range(batch.num_rows):
            side, dim, g, form, ids, data, bars = (batch.column(c)[r].as_py() for c in ("side", "dim", "g", "form", "ids", "data", "bars"))
            if (dim, g) != now:
                now, group = (dim, g), []
            block = _Block(data, ids, dim, form, scale) if side == 0 or group else None
            if side == 0:
                group.append(block)
            elif group:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _search(block, group, k, {x["query_id"]: x["bar"] for x in bars or []})], names=["query_id", "vec_id", "score"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, query_id): which queries a block holds."""
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            names = np.unique(np.frombuffer(ids, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), block)), pa.array(names)], names=["block", "query_id"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k highest integer inner products.

    Both sides have vec_id and embedding; components become floor(scale * x), x as double.
    Every vector is a candidate, but those that have the query's vec_id; fewer than k
    candidates: all of them. Ties go to the smaller vec_id. Rows whose vec_id or vector is
    null, whose vector is empty or holds a null or non-finite component take no part;
    vectors of different lengths don't meet. Scores are exact for components of any size;
    those beyond the range of long are given, and ranked, as its limits. Repeated
    candidates are ranked one by one; repeated queries are ranked together, as one query.
    No query or no candidate: no rows.

    Candidates are packed into blocks, in the narrowest whole type (a byte for components
    between -2 and 2 at a scale of 64), blocks dealt to groups of at most about GROUP
    vectors; each block of queries is sent to every group, once. A worker holds one group
    and one block of queries. The groups are searched in rounds, each of which multiplies
    the number of those done by ROUND: a query goes to a round with its k-th best score so
    far, so that from the first block on only what can reach it is compared to the end and
    returned (about ROUND * k rows a query and round, however many groups there are).
    Vectors with a component of 2 ** 53 or more after scaling are compared in whole numbers
    of any size, hundreds of times as slowly.
    """

    def packed(df: DataFrame, size: int) -> DataFrame:
        return df.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(lambda it: _blocks(it, scale, size), _BLOCK)

    blocks = cut(packed(vectors, CANDIDATES))
    counted = blocks.agg(F.count("*"), F.sum("n")).first()
    number = max(1, -(-(counted[1] or 0) // GROUP), min(counted[0], LEAST_GROUPS))
    candidates = blocks.select(F.lit(0).alias("side"), "dim", F.pmod(F.xxhash64("key", "ids"), F.lit(number)).alias("g"), "form", "ids", "data")
    asked = cut(packed(queries, QUERIES).withColumn("block", F.monotonically_increasing_id()))
    holds = asked.select("block", "ids").mapInArrow(_members, "block bigint, query_id bigint")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    none = F.lit(None).cast("array<struct<query_id: bigint, bar: bigint>>")
    best, done = None, 0
    while done < number:
        upto = min(number, max(1, done * ROUND))
        sent = asked.withColumn("bars", none)
        if best is not None:
            reached = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
            bars = holds.join(reached, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "bar")).alias("bars"))
            sent = asked.join(bars, "block", "left")
        sent = sent.select(F.lit(1).alias("side"), "dim", F.explode(F.sequence(F.lit(done).cast("bigint"), F.lit(upto - 1).cast("bigint"))).alias("g"), "form", "ids", "data", "bars")
        met = candidates.where(F.col("g").between(done, upto - 1)).withColumn("bars", none).union(sent)
        met = met.repartition("dim", "g").sortWithinPartitions("dim", "g", "side")
        found = met.mapInArrow(lambda it: _run(it, k, scale), "query_id bigint, vec_id bigint, score bigint")
        found = found if best is None else best.select("query_id", "vec_id", "score").union(found)
        best, done = found.withColumn("rank", place).where(F.col("rank") <= k), upto
        if done < number:
            best = cut(best)
    return best.select("query_id", "rank", "vec_id", "score")
