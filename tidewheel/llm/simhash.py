"""SimHash near-duplicates: fingerprints of word shingles, exact pairs by vantage-point trees.

Fingerprints of texts that have nothing in common lie 32 +- 4 bits apart, so a tree over
all 64 bits cuts little: of two halves around a median distance, a ball of radius 4 meets
both for two points in three, and its queries visit most of the tree. The trees here
therefore use Hamming distance on part of the bits, which obeys the triangle inequality
too. The 64 bits are cut into k > radius blocks; two fingerprints within the radius agree
on at least k - radius whole blocks. For each choice of k - radius blocks there is one
tree over the distance on those bits alone, in which every pair sought is at distance 0
in at least one tree. A level of a tree has a vantage point and a branch for each distance
from it; by the triangle bound a partner at distance 0 is in the same branch at each
level, so no query overlaps a boundary and the branches can be shards of a join. Within a
shard a tree on all bits goes on: each level's vantage point parts the members by distance,
a branch is carried on against all branches whose distances lie within the radius of its
own (those whose boundaries its balls overlap), all others are pruned by the triangle
bound, and members of small pairs of branches are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import cut
from tidewheel.llm.components import classes
from tidewheel.llm.shards import deal, groups, roots

BITS = 64
SEED = 42
#: Members that a shard shall have on average, at most.
AIM = 2048
#: Shards of up to so many members are compared many shards at a time.
SMALL = 48
#: Pairs of a leaf of the tree within a shard, at most, and its levels.
LEAF, LEVELS = 1 << 15, 4


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint, unsigned. Null, empty and blank texts have fingerprint 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row; fp holds the unsigned fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


def layout(n: int, radius: int) -> list[int]:
    """The bit masks of the trees for n fingerprints: as few blocks as keep shards near AIM members."""
    for blocks in range(radius + 1, radius + 5):
        keep = blocks - radius
        if n <= AIM << (BITS * keep // blocks) or blocks == radius + 4:
            break
    edges = [BITS * b // blocks for b in range(blocks + 1)]
    single = [((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in range(blocks)]
    return [sum(x) for x in combinations(single, keep)]


def _vantage_points(mask: int, number: int) -> list[int]:
    return [xxhash.xxh64_intdigest(f"vantage {mask} {i}") & mask for i in range(number)]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of words; the arguments are broadcast against one another."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) if x.shape[-1] > 1 else np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int64)


def _pairs(fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, level: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (from a, from b) of fingerprints within the radius, by a vantage-point tree that both descend together."""
    if not len(a) or not len(b):
        return []
    out = []
    if len(a) * len(b) <= LEAF or level == LEVELS:
        for at in range(0, len(a), 256):
            i, j = np.nonzero(_apart(fp[a[at : at + 256], None], fp[b][None, :]) <= radius)
            out.append((a[at + i], b[j]))
        return out
    pivot = fp[a[level * 7919 % len(a)]]
    da, db = _apart(fp[a], pivot), _apart(fp[b], pivot)
    a, b = a[np.argsort(da, kind="stable")], b[np.argsort(db, kind="stable")]
    da, db = np.sort(da), np.sort(db)
    for d in np.unique(da):  # a branch, and the branches that its boundary overlaps
        x = a[np.searchsorted(da, d) : np.searchsorted(da, d, "right")]
        y = b[np.searchsorted(db, d - radius) : np.searchsorted(db, d + radius, "right")]
        out += _pairs(fp, x, y, radius, level + 1)
    return out


def _links(fp: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie together what all pairs (from a, from b) within the radius would; a and b are index arrays without common members, or the same.

    Members within the radius of a vantage point are linked to it, so pairs of two of them
    need no comparison: a dense group costs little more than its size.
    """
    same, pivot = a is b, a[0]
    near_a = _apart(fp[a], fp[pivot]) <= radius
    near_b = near_a if same else _apart(fp[b], fp[pivot]) <= radius
    tied = a[near_a] if same else np.concatenate([a[near_a], b[near_b]])
    out = [(np.full(len(tied), pivot), tied), *_pairs(fp, a[~near_a], b, radius)]
    if not same:
        out += _pairs(fp, a[near_a], b[~near_b], radius)
    i, j = (np.concatenate([o[k] for o in out]) for k in (0, 1))
    different = i != j
    return i[different], j[different]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fingerprints as rows of words, from a column of numbers or of arrays of numbers."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(flat.type):
        return flat.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(flat), -1)
    return flat.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for rows, bounds in groups(batches):
        fp = _matrix(rows.column("fp"))
        node = rows.column("node").to_numpy()
        lo, hi, chunk = (rows.column(c).to_numpy() for c in ("lo", "hi", "chunk"))
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        found = []
        small = np.flatnonzero((sizes <= SMALL)[group])
        for shift in range(1, min(SMALL, int(sizes.max(initial=1)))):
            small = small[small + shift < len(fp)]
            small = small[group[small] == group[small + shift]]
            i = small[_apart(fp[small], fp[small + shift]) <= radius]
            found.append((i, i + shift))
        for g in np.flatnonzero(sizes > SMALL):
            at = np.arange(bounds[g], bounds[g + 1])
            if lo[at[0]] == hi[at[0]]:
                found.append(_links(fp, at, at, radius))
            else:
                a, b = at[chunk[at] == lo[at]], at[chunk[at] == hi[at]]
                if len(a) and len(b):
                    found.append(_links(fp, a, b, radius))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in (0, 1))
        root = roots(len(fp), i, j)
        tied = np.flatnonzero(root != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[root[tied]])], names=["a", "b"])


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text, ...).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a text of fewer
    words than a shingle is one shingle; null, empty and blank texts have fingerprint 0 and
    link like any other. component_id is the least doc_id that links of at most `radius`
    bits reach. Repeated rows each return; rows that share an id but not the fingerprint
    are nodes of their own. A null doc_id returns with the component of its fingerprint
    (null if only null ids have it) and links nothing. No rows: no rows. Further columns of
    docs are ignored.

    Equal fingerprints are one node (aggregated before the shuffle), so groups of copies of
    any size cost one member of a shard; shards of many fingerprints are split by `deal`.
    Only a count of the fingerprints reaches the driver.
    """
    fps = cut(fingerprints(docs, shingle))
    nodes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")))
    trees = [(0, mask) for mask in layout(nodes.count(), radius)]
    members = nodes.select("fp", "node").mapInArrow(lambda it: _members(it, trees), _MEMBERS + "bigint")
    edges = deal(members, "fp").select("shard", "lo", "hi", "chunk", "fp", "node").mapInArrow(lambda it: _compare(it, radius), "a bigint, b bigint")
    out = fps.join(classes(nodes, edges).select("fp", "least"), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


_MEMBERS = "shard bigint, node bigint, fp "


def _layers(fp: np.ndarray, trees: list[tuple[int, int]]) -> np.ndarray:
    """Rows of words as far as the trees' numbers of words go: after the fingerprints' own, the same bits in other orders."""
    words = fp.shape[1]
    more = max(word for word, _ in trees) // words
    if not more:
        return fp
    bits = np.unpackbits(fp.view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    orders = [np.random.default_rng(r).permutation(words * BITS) for r in range(1, more + 1)]
    return np.concatenate([fp, *(np.packbits(np.ascontiguousarray(bits[:, o]), axis=1, bitorder="little").view(np.uint64) for o in orders)], axis=1)


def _members(batches: Iterator[pa.RecordBatch], trees: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Each (fp, node) once for each tree (a word and a mask), with the shard that its distances from the tree's vantage points name."""
    points = [np.array(_vantage_points(mask, mask.bit_count() * 2 // 3), dtype=np.uint64) for _, mask in trees]
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            fp = _layers(_matrix(batch.column(0)), trees)
            shards = np.empty((len(trees), len(fp)), dtype=np.uint64)
            for t, (word, mask) in enumerate(trees):
                code = np.full(len(fp), t + 1, dtype=np.uint64)
                part = fp[:, word] & np.uint64(mask)
                for v in points[t]:  # a level of the tree: the branch of each distance
                    code = (code ^ np.bitwise_count(part ^ v).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    code ^= code >> np.uint64(31)
                shards[t] = code
            each = pa.array(np.tile(np.arange(len(fp)), len(trees)))
            yield pa.RecordBatch.from_arrays([pa.array(shards.ravel().view(np.int64)), batch.column(1).take(each), batch.column(0).take(each)], names=["shard", "node", "fp"])


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The set of a text's word shingles, by hashes, ascending; empty for a text without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    whole = b" ".join(tokens)
    ends = np.cumsum([len(w) + 1 for w in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[min(shingle, len(tokens)) - 1 :].tolist())], dtype=np.uint64))


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """A fingerprint of `words` times 64 bits of a set of hashes: each word from another mixing of them."""
    ones = np.zeros((words, BITS), dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        for w in range(words):
            mixed = (part ^ np.uint64(0x9E3779B97F4A7C15 * (2 * w + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(32)
            ones[w] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.uint64).reshape(words)


#: Low bits of a shard that hold its tree's number.
_TREE = 10
#: Part of the pairs at the threshold that may miss every tree.
MISS = 0.01


def blocks(n: int, words: int, share: float, least_block: int = 12, miss: float = MISS) -> list[tuple[int, int]]:
    """The trees (a word, counted on through further orders of the bits, and a mask) for n wide fingerprints.

    The blocks grow with n and so does the number of trees: a pair that differs in each bit
    with probability `share` misses all of them in at most `miss` of cases. Trees share
    bits, so the chance is summed over the number of bits that differ.
    """
    bits = words * BITS
    block = min(24, max(least_block, (n // AIM).bit_length()))
    weight = np.array([math.comb(bits, d) * share**d * (1 - share) ** (bits - d) for d in range(bits + 1)])
    none = np.array([1 - math.comb(bits - d, block) / math.comb(bits, block) for d in range(bits + 1)])
    low, high = 1, (1 << _TREE) - 1
    while low < high:
        half = (low + high) // 2
        low, high = (low, half) if weight @ none**half <= miss else (half + 1, high)
    each = BITS // block
    return [(t // each, ((1 << block) - 1) << (block * (t % each))) for t in range(low)]


def _numbered(batches: Iterator[pa.RecordBatch], trees: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """`_members` with the tree's number in the shard."""
    for batch in _members(batches, trees):
        tree = np.repeat(np.arange(len(trees)), batch.num_rows // len(trees))
        shard = batch.column(0).to_numpy(zero_copy_only=False) >> _TREE << _TREE | tree
        yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns[1:]], names=batch.schema.names)


class _Candidates:
    """The pairs of some groups' members within the radius."""

    def __init__(self, rows: pa.Table, bounds: np.ndarray, trees: list[tuple[int, int]], radius: int):
        self.fp, self.bounds, self.radius = _matrix(rows.column("fp")), bounds, radius
        self.tree = rows.column("shard").to_numpy() & (1 << _TREE) - 1
        self.lo, self.hi, self.chunk = (rows.column(c).to_numpy() for c in ("lo", "hi", "chunk"))
        self.trees = trees
        self.words, self.masks = np.array([w for w, _ in trees]), np.array([m for _, m in trees], dtype=np.uint64)

    def fresh(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs agree in no earlier tree, where they have met too."""
        out = np.ones(len(i), bool)
        for at in range(0, len(i), 32768):
            x, y = i[at : at + 32768], j[at : at + 32768]
            agree = _layers(self.fp[x] ^ self.fp[y], self.trees)[:, self.words] & self.masks == 0
            out[at : at + 32768] = ~(agree & (np.arange(len(self.masks)) < self.tree[x][:, None])).any(axis=1)
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fp, sizes = self.fp, np.diff(self.bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero((sizes <= SMALL)[group])
        for shift in range(1, min(SMALL, int(sizes.max(initial=1)))):
            small = small[small + shift < len(fp)]
            small = small[group[small] == group[small + shift]]
            i = small[_apart(fp[small], fp[small + shift]) <= self.radius]
            j = i + shift
            met = (self.lo[i] == self.hi[i]) | (self.chunk[i] != self.chunk[j])
            yield i[met], j[met]
        for g in np.flatnonzero(sizes > SMALL):
            at = np.arange(self.bounds[g], self.bounds[g + 1])
            same = self.lo[at[0]] == self.hi[at[0]]
            a, b = (at, at) if same else (at[self.chunk[at] == self.lo[at]], at[self.chunk[at] == self.hi[at]])
            for i, j in _pairs(fp, a, b, self.radius):
                yield (i[i < j], j[i < j]) if same else (i, j)


def _met(batches: Iterator[pa.RecordBatch], trees: list[tuple[int, int]], radius: int) -> Iterator[pa.RecordBatch]:
    """The members of each group that have a candidate there which they have not met in an earlier tree."""
    for rows, bounds in groups(batches):
        some = _Candidates(rows, bounds, trees, radius)
        has = np.zeros(rows.num_rows, bool)
        for i, j in some.pairs():
            fresh = some.fresh(i, j)
            has[i[fresh]] = has[j[fresh]] = True
        yield from rows.filter(pa.array(has)).combine_chunks().to_batches()


def _alike(sets: list[np.ndarray], i: int, j: np.ndarray, similarity: float) -> np.ndarray:
    """Those of j whose sets have at least that Jaccard similarity to the set of i, exactly."""
    own, size = sets[i], np.array([len(sets[k]) for k in j.tolist()], dtype=np.int64)
    possible = (np.minimum(size, len(own)) >= similarity * np.maximum(size, len(own)) - 1e-9) & (size > 0)
    j, size = j[possible], size[possible]
    if not len(j) or not len(own):
        return j[:0]
    every = np.concatenate([sets[k] for k in j.tolist()])
    hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
    common = np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
    return j[common >= similarity * (size + len(own) - common) - 1e-9]


def _verified(batches: Iterator[pa.RecordBatch], trees: list[tuple[int, int]], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): ties by candidate pairs whose sets are alike; a pair that others tie already is not compared."""
    for rows, bounds in groups(batches):
        some = _Candidates(rows, bounds, trees, radius)
        node = rows.column("node").to_numpy()
        sets = [np.frombuffer(z.as_buffer(), np.uint64) for z in rows.column("z").combine_chunks()]
        label = np.arange(len(sets))
        members = {k: [k] for k in range(len(sets))}
        for i, j in some.pairs():
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            edges = np.append(np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])[: len(i)]), len(i))
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                one, others = int(i[start]), j[start:end]
                others = others[label[others] != label[one]]
                others = others[some.fresh(np.full(len(others), one), others)] if len(others) else others
                for at in range(0, len(others), 64):
                    part = others[at : at + 64]
                    for k in _alike(sets, one, part[label[part] != label[one]], similarity).tolist():
                        x, y = int(label[one]), int(label[k])
                        if x != y:
                            x, y = (x, y) if len(members[x]) >= len(members[y]) else (y, x)
                            label[members[y]] = x
                            members[x] += members.pop(y)
        tied = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[label[tied]])], names=["a", "b"])


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 6, least_block: int = 12) -> DataFrame:
    """(doc_id, k, component_id, kept) of near-duplicates: texts link whose sets of word shingles have at least that Jaccard similarity.

    Candidates come from wide fingerprints of the sets, links from the whole sets. Sets of
    that similarity differ by an angle, and so in a share p of the bits of a fingerprint:
    cos(pi p) = 2 s / (1 + s) for sets alike in size, more for others. Candidates differ in
    at most that share and five deviations more; unrelated ones differ in half the bits,
    about ten deviations away. At such distances no set of blocks is sure to agree, so there
    are trees for blocks of about the binary logarithm of the number of sets, and as many
    that a pair at the threshold misses all in at most 1 % of cases by calculation, whatever
    the number of sets (see `blocks`). No pair below the similarity links, other than by a chain of links.

    Equal sets are one node. Members that have a candidate in a shard go there once more,
    with their set; a pair is compared in the first tree in which it agrees, unless others
    tie it already. Pairs are never rows. Hashes of 64 bits stand for shingles and for
    whole sets.

    Each row returns: k is the hash of its id and text (`row_key`), component_id the least
    doc_id of its group (null if no row of it has an id), kept whether the row is the one
    that stands for its group: that of the least id (rows without one come last), of
    several with that id the one of the least k; rows alike in id and text are all or none
    of them kept. Texts without a word have equal, empty sets. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), shingle) for x in batch.column(2)]
            found = [wide_fingerprint(x, words) for x in sets]
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            offsets = pa.array(np.arange(0, len(flat) + 1, words), pa.int32())
            key = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(key), pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64)))], names=["doc_id", "k", "node", "fp"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), shingle).tobytes() for x in batch.column(0)]
            key = np.array([xxhash.xxh64_intdigest(x, SEED) for x in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sets, pa.binary())], names=["node", "z"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("k"), F.col("text").cast("string").alias("text"))
    fps = cut(texts.mapInArrow(run, "doc_id bigint, k bigint, node bigint, fp array<bigint>"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    nodes = cut(fps.groupBy("node").agg(F.min(first).alias("least"), F.first("fp").alias("fp")))
    bits = words * BITS
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = int(bits * share + 5 * math.sqrt(bits * share * (1 - share)))
    trees = blocks(nodes.count(), words, share, least_block)

    kind = "shard bigint, lo int, hi int, chunk int, node bigint, fp array<bigint>"
    members = nodes.select("fp", "node").mapInArrow(lambda it: _numbered(it, trees), _MEMBERS + "array<bigint>")
    met = cut(deal(members, "fp").select("shard", "lo", "hi", "chunk", "node", "fp").mapInArrow(lambda it: _met(it, trees, radius), kind))
    wanted = met.select("node").distinct().join(nodes.select("node", "least.k"), "node").select("k").distinct()
    sets = texts.join(wanted, "k", "left_semi").dropDuplicates(["k"]).select("text").mapInArrow(whole, "node bigint, z binary").dropDuplicates(["node"])
    dealt = met.join(sets, "node").repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi")
    ties = dealt.select("shard", "lo", "hi", "chunk", "node", "fp", "z").mapInArrow(lambda it: _verified(it, trees, radius, similarity), "a bigint, b bigint")
    groups_ = classes(nodes.select("node", "least"), ties).select("node", F.col("least.doc_id").alias("component_id"), F.col("least.k").alias("stands"))
    return fps.select("doc_id", "k", "node").join(groups_, "node", "left").select("doc_id", "k", "component_id", (F.col("k") == F.col("stands")).alias("kept"))


def row_key():
    """The hash of a row's id and text by which `similar` names rows."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
