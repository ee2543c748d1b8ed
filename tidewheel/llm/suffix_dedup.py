"""Removal of repeated byte strings by external induced suffix sorting.

Only suffixes that can share WINDOW bytes with another need sorting. Every window of that
length has a content-chosen anchor (see `anchors`), and equal windows have equal anchors;
so an anchor's surroundings (the bytes of its windows, at most 168) are sorted only if the
anchor occurs elsewhere in other surroundings. Where whole surroundings are equal, all but
the first repeat it by that alone. The rest is dealt to shards by anchor, each of which is
sorted by external induction (see `induced`), which carries common prefixes along: windows
with a common prefix of WINDOW bytes or more are neighbours in the order, and all but the
first of them are removed.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm import anchors
from tidewheel.llm.anchors import WINDOW
from tidewheel.llm.common import checkpoint_folder, cut
from tidewheel.llm.induced import BLOCK, EQUAL, room, suffixes

#: Surroundings of an anchor up to which they make one shard in any case (see `_frequent`); more are dealt by CELL windows each, by the bytes those share.
MANY, CELL = 256, 4
#: Bytes of a shard's text, and of each other array as long, that are held in memory; more lie in unnamed files.
HELD = 16 << 20
#: Partitions of texts to be sorted for each usual one.
FINER = 4
_LAST = 2**63 - 1
#: Above all hashes of anchors.
RANGE = 1 << 40


def _document(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, k, text): doc orders the documents (a null id last), k a hash of the text, tells apart texts that share an id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    return one.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("k"), "text")


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


_ANCHORS = "h bigint, c bigint, doc bigint, k bigint, pack bigint"
#: kind 0: a removed range (start and length packed); 1: an anchor to be sorted with others of its h.
_FOUND = "kind int, h bigint, doc bigint, k bigint, pack bigint, length bigint"


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An anchor's row: pack holds its place, and how far before it its windows start, first and last.

    Of the same surroundings met several times in a batch only the first goes on, so that a
    frequent passage is few rows; the others' ranges, joined where they touch, are rows with
    h from RANGE on (which spreads them by document) and their length as c.
    """
    for batch in batches:
        texts = _bytes(batch.column(2))
        doc, k = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        at, parts = 0, []
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (not size or size + len(texts[end]) < anchors.CHUNK):
                size += len(texts[end])
                end += 1
            ends = np.cumsum([len(t) for t in texts[at:end]])
            data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
            for d, place, first, last, gram, context in _in_pieces(data, ends):
                pack = place << 14 | (place - first) << 7 | (place - last)
                parts.append(((gram >> np.uint64(24)).astype(np.int64), context.view(np.int64), doc[at + d], k[at + d], pack))
            at = end
        if not parts:
            continue
        h, c, d, k, pack = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((pack, k, d, c))
        h, c, d, k, pack = h[order], c[order], d[order], k[order], pack[order]
        first = np.concatenate([[True], c[1:] != c[:-1]])[: len(c)]
        yield _rows(h[first], c[first], d[first], k[first], pack[first])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        again = (d != d[lead]) | (k != k[lead]) | (pack != pack[lead])
        start, length = _range_of(pack[again])
        yield _rows(*_joined(d[again], k[again], start, length))


def _in_pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The anchors of texts; a single long text goes in pieces of CHUNK window starts, so that its length has no bound.

    An anchor whose windows lie in two pieces has two rows, each with its own windows; where
    that makes its surroundings unlike those of its copies, they are sorted.
    """
    if len(ends) > 1 or len(data) <= anchors.CHUNK + WINDOW:
        yield anchors.of(data, ends)
        return
    for at in range(0, len(data) - WINDOW + 1, anchors.CHUNK):
        piece = data[at : at + anchors.CHUNK + WINDOW - 1]
        d, place, first, last, gram, context = anchors.of(piece, np.array([len(piece)]))
        yield d, place + at, first + at, last + at, gram, context


def _rows(h: np.ndarray, c: np.ndarray, doc: np.ndarray, k: np.ndarray, pack: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, doc, k, pack)], names=["h", "c", "doc", "k", "pack"])


def _joined(doc: np.ndarray, k: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges as rows, those of a document that touch joined into one; start is packed."""
    order = np.lexsort((start, k, doc))
    doc, k, start, length = doc[order], k[order], start[order], length[order]
    of = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])])[: len(doc)])
    begin = start >> 14 & 0x7FFFFFFF
    reach = np.maximum.accumulate(of << 32 | begin + length)
    new = np.concatenate([[True], (of[1:] << 32 | begin[1:]) > reach[:-1]])[: len(doc)]
    last = np.append(np.flatnonzero(new)[1:], len(doc))[: new.sum()] - 1
    total = (reach[last] & 0xFFFFFFFF) - begin[new]
    spread = (anchors.mix(doc[new].view(np.uint64)) >> np.uint64(24)).astype(np.int64)
    return spread | RANGE, total, doc[new], k[new], start[new]


def _found(kind: int, h: np.ndarray, doc: np.ndarray, k: np.ndarray, pack: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), *(pa.array(np.asarray(x, dtype=np.int64)) for x in (h, doc, k, pack, length))], names=["kind", "h", "doc", "k", "pack", "length"])


def _range_of(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start packed, length) of the bytes that an anchor's windows cover."""
    first, last = pack >> 7 & 127, pack & 127
    return ((pack >> 14) - first) << 14, first - last + WINDOW


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (h, c, doc, k, pack): repeats of the same surroundings as ranges, and of each h with several surroundings their first occurrences."""
    before = None  # the last row, and the first of its surroundings
    pending, several = None, False  # the only surroundings of the last h so far; whether there are more
    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, doc, k, pack = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        known = h >= RANGE
        yield _found(0, h[known], doc[known], k[known], pack[known], c[known])
        h, c, doc, k, pack = (x[~known] for x in (h, c, doc, k, pack))
        if not len(h):
            continue
        ph, pc, pd, pk, pp = (np.concatenate([[x if before else ~y[0]], y[:-1]]) for x, y in zip(before or (0, 0, 0, 0, 0), (h, c, doc, k, pack)))
        new_h = h != ph
        new_c = new_h | (c != pc)
        again = ~new_c & ((doc != pd) | (k != pk) | (pack != pp))
        start, length = _range_of(pack[again])
        yield _found(0, h[again], doc[again], k[again], start, length)
        first = np.flatnonzero(new_c)
        group = np.cumsum(new_h)[first]  # 0: goes on from the last batch
        size = np.bincount(group, minlength=int(new_h.sum()) + 1)
        size[0] += bool(pending) + 2 * several
        if pending and size[0] > 1:
            yield _found(1, *(np.array([x]) for x in pending), np.zeros(1))
            pending, several = None, True
        out = first[size[group] > 1]
        open_group = int(new_h.sum())
        yield _found(1, h[out], doc[out], k[out], pack[out], np.zeros(len(out)))
        if open_group:
            mine = first[group == open_group]
            several = len(mine) > 1
            pending = None if several else (h[mine[0]], doc[mine[0]], k[mine[0]], pack[mine[0]])
        before = (h[-1], c[-1], doc[-1], k[-1], pack[-1])


_PACKED = "doc_id bigint, doc bigint, k bigint, z binary"


def _compressed(docs: DataFrame) -> DataFrame:
    """Documents as they are shuffled: compressed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([press.compress(t) for t in _bytes(b.column(3))], pa.binary())], names=["doc_id", "doc", "k", "z"])

    return docs.mapInArrow(run, _PACKED)


_PIECES = "kind int, part bigint, shard bigint, doc bigint, k bigint, pack bigint, length bigint, body binary"
_DEALT = "kind int, shard bigint, doc bigint, k bigint, pack bigint, length bigint, body binary"
#: Kinds of rows: ranges to be removed, bodies to be sorted by shard, and bodies of cells, of which equal ones go on once.
_RANGE, _BODY, _CELL = 0, 1, 2


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings to be sorted (length: how many windows start in the body), those of frequent anchors by cells, with ranges for cells that repeat within a batch.

    part says where a row goes: bodies by shard, cells by their bodies, ranges anywhere.
    """
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        rows, seen, gone = [], {}, []
        for doc, k, z, of in zip(*(batch.column(c).to_pylist() for c in ("doc", "k", "z", "of"))):
            data = open_.decompress(z)
            for a in of:
                pack = a["pack"]
                place, lo, hi = pack >> 14 & 0x7FFFFFFF, pack >> 7 & 127, pack & 127
                if not a["hot"]:
                    rows.append((_BODY, a["h"], a["h"], doc, k, (place - lo) << 14, lo - hi + 1, data[place - lo : place - hi + WINDOW]))
                    continue
                for cell in range(hi // CELL, lo // CELL + 1):
                    core = data[place - cell * CELL : place - cell * CELL - CELL + 1 + WINDOW]
                    far, near = min(lo, cell * CELL + CELL - 1), max(hi, cell * CELL)
                    body = data[place - far : place - near + WINDOW]
                    shard = xxhash.xxh64_intdigest(core, a["h"] & 0xFFFF_FFFF ^ cell) >> 1
                    row = (_CELL, xxhash.xxh64_intdigest(body, shard) >> 1, shard, doc, k, (place - far) << 14, far - near + 1, body)
                    old = seen.get(key := (shard, body))
                    if old is None or row[3:6] < old[3:6]:
                        seen[key] = row
                        row = old
                    if row and row[3:6] != seen[key][3:6]:
                        gone.append((_RANGE, row[3] ^ row[4], 0, *row[3:6], row[6] - 1 + WINDOW, None))
        both = [*rows, *seen.values(), *gone]
        kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in both], kind) for i, kind in enumerate(kinds)], names=["kind", "part", "shard", "doc", "k", "pack", "length", "body"])


def _first_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sorted by kind, part, shard, doc, k, pack) without part; of equal cells the first stays and the others become ranges."""
    before = (-1, -1, 0, 0, 0)  # the cell that is open, and its first row
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, part, shard, doc, k, pack, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
        at = np.flatnonzero(kind == _CELL)
        stays = np.ones(len(kind), bool)
        if len(at):
            mine = [np.concatenate([[x], y[at]]) for x, y in zip(before, (part, shard, doc, k, pack))]
            new = np.concatenate([[True], (mine[0][1:] != mine[0][:-1]) | (mine[1][1:] != mine[1][:-1])])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            same = np.logical_and.reduce([x == x[lead] for x in mine[2:]])
            kind, length = kind.copy(), length.copy()
            again = at[~new[1:] & ~same[1:]]
            kind[again], length[again] = _RANGE, length[again] - 1 + WINDOW
            stays[at[~new[1:] & same[1:]]] = False  # a row met twice
            before = tuple(int(x[lead[-1]]) for x in mine)
        body = batch.column(7).take(pa.array(np.arange(len(kind)), mask=kind == _RANGE))
        out = pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (shard, doc, k, pack, length)), body], names=_NAMES)
        yield out.filter(pa.array(stays))


_NAMES = ["kind", "shard", "doc", "k", "pack", "length", "body"]


def _ranges(doc: np.ndarray, k: np.ndarray, pack: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    numbers = [pa.array(np.asarray(x, dtype=np.int64)) for x in (np.zeros(n), doc, k, pack, length)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, _RANGE, np.int32)), *numbers, pa.nulls(n, pa.binary())], names=_NAMES)


class _Rows:
    """Numbers appended part by part, in memory or (beyond HELD bytes) in an unnamed file, read as one array."""

    def __init__(self, kind, width: int = 1) -> None:
        self.parts, self.file, self.kind, self.width, self.size, self.held = [], None, np.dtype(kind), width, 0, 0

    def add(self, part: np.ndarray) -> None:
        self.parts.append(np.ascontiguousarray(part, dtype=self.kind))
        self.size += part.size
        self.held += self.parts[-1].nbytes
        if self.held > HELD:
            self.file = self.file or tempfile.TemporaryFile()
            self._out()

    def _out(self) -> None:
        for part in self.parts:
            self.file.write(part.tobytes())
        self.parts, self.held = [], 0

    def whole(self) -> np.ndarray:
        shape = (self.size // self.width, self.width) if self.width > 1 else (self.size,)
        if self.file is None:
            return np.concatenate(self.parts).reshape(shape)
        self._out()
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=shape)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges removed from a partition's shards; ranges and cells that came with them pass.

    The bodies make one text, with a mark between; it and its rows (doc, k, pack, windows
    that start in the body, place after the body) are in memory only up to HELD bytes.
    """
    text, table, end = _Rows(np.uint16), _Rows(np.int64, 5), 0
    for batch in batches:
        kind, doc, k, pack, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4, 5))
        yield pa.RecordBatch.from_arrays(batch.columns, names=_NAMES).filter(pa.array(kind != _BODY))
        at = np.flatnonzero(kind == _BODY)
        if not len(at):
            continue
        bodies = [b.as_py() for b in batch.column(6).take(pa.array(at))]
        sizes = np.array([len(b) + 1 for b in bodies], dtype=np.int64)
        each = np.zeros(sizes.sum(), np.uint16)
        ends = np.cumsum(sizes)
        inner = np.ones(len(each), bool)
        inner[ends - 1] = False
        each[inner] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint16) + 1
        text.add(each)
        table.add(np.stack([doc[at], k[at], pack[at], length[at], end + ends], axis=1))
        end += int(ends[-1])
    if not text.size:
        return
    rows = table.whole()
    ends = room(len(rows), np.int64, HELD)
    ends[:] = rows[:, 4]
    removed = room(text.size, bool, HELD)
    _mark(text.whole(), rows, ends, removed)
    for at in range(0, len(removed), BLOCK):
        flagged = np.flatnonzero(removed[at : at + BLOCK]) + at
        if not len(flagged):
            continue
        owner = np.searchsorted(ends, flagged, "right")
        new = np.concatenate([[True], (np.diff(flagged) != 1) | (np.diff(owner) != 0)])
        first = flagged[new]
        last = flagged[np.append(np.flatnonzero(new)[1:], len(flagged)) - 1]
        mine = rows[owner[new]]
        begin = np.where(owner[new] > 0, ends[np.maximum(owner[new] - 1, 0)], 0)
        yield _ranges(mine[:, 0], mine[:, 1], mine[:, 2] + ((first - begin) << 14), last - first + WINDOW)


def _mark(text: np.ndarray, rows: np.ndarray, ends: np.ndarray, removed: np.ndarray) -> None:
    """Marks every window start that has an equal window at an earlier place.

    Of the run of equal windows that is open at a block's end only the earliest goes on.
    """
    held, open_ = np.zeros(0, np.int64), EQUAL  # its place; the least common prefix met since
    for block, common in suffixes(text, 257, reach=WINDOW):
        block = block.astype(np.int64)
        owner = np.searchsorted(ends, block, "right")
        offset = np.where(owner > 0, ends[np.maximum(owner - 1, 0)], 0)
        at = np.flatnonzero(block - offset < rows[:, 3][owner])
        if not len(at):
            open_ = min(open_, int(common.min(initial=EQUAL)))
            continue
        low = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
        low[0] = min(int(low[0]), open_)
        open_ = int(common[at[-1] + 1 :].min(initial=EQUAL))
        block, new = np.concatenate([held, block[at]]), np.concatenate([np.ones(len(held), bool), low < WINDOW])
        run = np.cumsum(new)
        owner = np.searchsorted(ends, block, "right")
        mine = rows[owner]
        doc, k, place = mine[:, 0], mine[:, 1], mine[:, 2] + ((block - np.where(owner > 0, ends[np.maximum(owner - 1, 0)], 0)) << 14) >> 14
        size = np.bincount(run)
        several = np.flatnonzero(size[run] > 1)
        if len(several):
            order = several[np.lexsort((place[several], k[several], doc[several], run[several]))]
            first = np.concatenate([[True], run[order][1:] != run[order][:-1]])
            lead = order[first][np.cumsum(first) - 1]  # the earliest of each run
            own = (place[order] == place[lead]) & (doc[order] == doc[lead]) & (k[order] == k[lead])  # the same place met in two surroundings
            removed[block[order[~own]]] = True
            held = block[lead[-1:]] if run[order[-1]] == run[-1] else block[-1:]
        else:
            held = block[-1:]


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _result(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, z, of in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "of"))):
            data = open_.decompress(z)
            removed = spans = 0
            if of:
                starts, lengths = np.array([x["start"] for x in of]), np.array([x["length"] for x in of])
                change = np.bincount(starts, minlength=len(data) + 1) - np.bincount(starts + lengths, minlength=len(data) + 1)
                gone = np.cumsum(change)[: len(data)] > 0
                removed, spans = int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            else:
                rest = data
            for column, value in zip(out, (doc_id, len(data), removed, spans, hashlib.sha256(rest).hexdigest(), rest)):
                column.append(value)
        columns = [*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out[5], pa.binary())] if with_text else columns, names=[*names, "kept"] if with_text else names)


def _frequent(wanted: DataFrame, parts: int) -> DataFrame:
    """(h, n) of anchors in more than MANY surroundings, and in more than a partition's even share of all.

    A shard up to that share at most doubles its partition. By cells its rows would be
    several times as many and sorted in one more round, and with MANY alone the part of the
    rows that go that way would grow with the input.
    """
    share = max(MANY, -(-wanted.count() // parts))
    return cut(wanted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > share))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) for every row of docs (doc_id, text, ...).

    Each byte goes that is covered by a string of WINDOW bytes which starts earlier too, in
    a document with a smaller doc_id or before in its own. Null and empty texts have no
    bytes. A null doc_id comes after all others. Documents that share an id are ordered by
    a 64-bit hash of their texts; rows alike in both are one document and each return. Texts may have
    any length that a row can hold. No rows: no rows; further columns are ignored.

    Shuffled are five numbers for each anchor (about one in 32 bytes), the compressed
    texts twice, and the surroundings that need sorting. An anchor in more different
    surroundings than an even share of them all is dealt again by the bytes that few of its windows share (its cells);
    equal cells meet first, by their bytes, and only one of them goes on to be sorted with
    those that differ at their ends. So however many documents share a passage, a shard
    has no more rows than there are different ends. Repeats of whole surroundings are
    never sorted. Nothing reaches the driver.
    """
    spark = docs.sparkSession
    documents = _document(docs)
    anchored = documents.select("doc", "k", "text").where(F.length("text") >= WINDOW // 4).mapInArrow(_anchored, _ANCHORS)
    line = anchored.repartition("h").sortWithinPartitions("h", "c", "doc", "k", "pack")
    folder = checkpoint_folder(spark)
    line.mapInArrow(_classified, _FOUND).write.parquet(f"{folder}/anchors")
    found = spark.read.schema(_FOUND).parquet(f"{folder}/anchors")
    wanted = found.where("kind = 1").select("h", "doc", "k", "pack")
    # Sorting in memory is the faster, so shards are a fraction of a usual partition; beyond it, it goes by way of files.
    parts = FINER * int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = _frequent(wanted, parts)
    marked = wanted.join(many, "h", "left").select("doc", "k", F.struct("h", "pack", F.col("n").isNotNull().alias("hot")).alias("a"))
    of = marked.groupBy("doc", "k").agg(F.collect_list("a").alias("of"))
    packed = _compressed(documents)
    met = of.join(packed, ["doc", "k"])
    pieces = met.select("doc", "k", "z", "of").mapInArrow(_pieces, _PIECES).repartition(parts, "part").sortWithinPartitions("kind", "part", "shard", "doc", "k", "pack")
    # Written, as both the ranges and the cells left are read from it.
    pieces.mapInArrow(lambda it: _sorted(_first_cells(it)), _DEALT).write.parquet(f"{folder}/pieces")
    dealt = spark.read.schema(_DEALT).parquet(f"{folder}/pieces")
    cells = dealt.where(F.col("kind") == _CELL).withColumn("kind", F.lit(_BODY)).repartition(parts, "shard").mapInArrow(_sorted, _DEALT)
    known = found.where("kind = 0").union(dealt.where(F.col("kind") == _RANGE).select(F.col("kind"), F.col("shard"), "doc", "k", "pack", "length"))
    ranges = known.select("doc", "k", "pack", "length").union(cells.select("doc", "k", "pack", "length"))
    place = F.struct(F.shiftright("pack", 14).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("start"), F.col("length").cast("int").alias("length"))
    each = ranges.select("doc", "k", place.alias("r")).groupBy("doc", "k").agg(F.collect_list("r").alias("of"))
    kind = _RESULT + (", kept binary" if with_text else "")
    return packed.join(each, ["doc", "k"], "left").select("doc_id", "z", "of").mapInArrow(lambda it: _result(it, with_text), kind)
