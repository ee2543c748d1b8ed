"""Packing by power-of-two decomposition: every sequence is one piece of one document, of a binary length.

A document of n tokens is cut into floor(n / longest) pieces of the longest length and one
piece for each binary digit of the rest, longest first. Pieces of a length form a bucket,
from which batches of equal lengths are drawn: no sequence crosses documents, and none
needs padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct segments whose ids a worker remembers before it starts anew.
REMEMBERED = 500_000
_SIMPLE = "ɏ"
_OTHER = re.compile(f"[^\0-{_SIMPLE}]")


class Tokenizer:
    """Ids of a byte-level BPE from a tokenizers file, with the segments between blanks remembered.

    The vocabulary's pattern starts a token at each single blank between two other
    characters, so the stretches between such blanks are encoded independently of their
    neighbours; a text with other white space around a blank is encoded as a whole. The
    strings of the file's added tokens become those tokens, as the library has it, unless
    `plain` makes them ordinary text. New words are encoded together in one call. With
    `ranks` (the same vocabulary as a tiktoken file, and its pattern) that library encodes
    them, and whole texts in Latin letters without such strings at once, in which both
    libraries part words alike; it gives the same ids several times as fast.
    """

    def __init__(self, path: str, ranks: tuple[str, str] | None = None, plain: bool = False):
        from tokenizers import Tokenizer as File

        self.file, self.fast = File.from_file(path), None
        self.file.encode_special_tokens = plain
        # Strings that mustn't be encoded beside others, and those that the cut at blanks would tear.
        added = [t.content for t in self.file.get_added_tokens_decoder().values()]
        self.added, self.torn = [a for a in added if " " not in a], [a for a in added if " " in a]
        if ranks:
            import tiktoken

            with open(ranks[0], "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})
            self.size = np.zeros(max(table.values()) + 1, np.int64)
            for token, i in table.items():
                self.size[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # place of a word; -1: one that can't be encoded alone
        self.stored = 0
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(8192, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.file.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Adds words, each to be encoded with a blank before it; characters of one or two bytes."""
        line = " " + " ".join(words)
        ids = self._fast_ids(line) if self.fast else None
        if ids is not None:
            ends, lengths = np.cumsum(self.size[ids]), [len(w.encode()) + 1 for w in words]
        else:
            found = self.file.encode(line, add_special_tokens=False)
            ids = np.array(found.ids, dtype=np.uint32)
            ends, lengths = np.array([b for _, b in found.offsets], dtype=np.int64), [len(w) + 1 for w in words]
        # A token belongs to the word in which its last character (or byte) lies.
        cuts = np.searchsorted(ends, np.cumsum(lengths), "right")
        self._store(words, ids, np.diff(np.concatenate([[0], cuts])))

    def _store(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = self.stored
        while n + len(words) > len(self.starts):
            self.starts, self.lengths = np.concatenate([self.starts, self.starts]), np.concatenate([self.lengths, self.lengths])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        self.starts[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.lengths[n : n + len(words)] = counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.stored += len(words)
        self.known.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = [self._direct(t) for t in texts]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._by_words([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _direct(self, text: str) -> np.ndarray | None:
        if self.fast is None or not (text.isascii() or _OTHER.search(text) is None) or any(a in text for a in (*self.added, *self.torn)):
            return None
        return self._fast_ids(text)

    def _fast_ids(self, text: str) -> np.ndarray | None:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
        except ValueError:  # its pattern has no room for white space of a million characters
            return None

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        if self.stored > REMEMBERED:
            self._forget()
        cuts = [t.split(" ") for t in texts]
        new: set[str] = set()
        for c in cuts:
            new.update(c[1:])
        plain, added = [], [a for a in self.added if any(a in t for t in texts)]
        for w in new.difference(self.known) if len(new) > len(self.known) else [w for w in new if w not in self.known]:
            if not w or len(w.strip()) < len(w):
                self.known[w] = -1  # the white space around it is one run
            elif (w.isascii() or max(w) <= _SIMPLE) and not (added and any(a in w for a in added)):
                plain.append(w)
            else:  # one by one: a token may end within a character, and offsets count characters
                self._store([w], ids := self.whole(" " + w), np.array([len(ids)]))
        for at in range(0, len(plain), 4096):
            self._learn(plain[at : at + 4096])
        return [self._gather(t, c) for t, c in zip(texts, cuts)]

    def _gather(self, text: str, cut: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.known.__getitem__, cut[1:]), np.int64, len(cut) - 1)
        if not len(at) or at.min() < 0 or not cut[0] or cut[0][-1].isspace() or any(a in text for a in self.torn):
            return self.whole(text)
        lengths, starts = self.lengths[at], self.starts[at]
        ends = np.cumsum(lengths)
        return np.concatenate([self.whole(cut[0]), self.pool[np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)]])


def lengths(n: int, longest: int) -> np.ndarray:
    """Lengths of the pieces of n tokens."""
    rest = n % longest
    return np.array([longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _cut(batches: Iterator[pa.RecordBatch], path: str, ranks: tuple[str, str] | None, longest: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = Tokenizer(path, ranks)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            out: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                size = lengths(len(ids), longest)
                start = np.cumsum(size) - size
                out[0] += [doc] * len(size)
                out[1].append(start)
                out[2].append(size)
                for a, n in zip(start.tolist(), size.tolist()):
                    out[3].append(zlib.crc32(ids[a : a + n].tobytes()))
                    if with_ids:
                        out[5].append(ids[a : a + n])
                out[4].append(np.full(len(size), len(ids)))
            columns = [pa.array(out[0], pa.int64()), *(pa.array(np.concatenate(out[c])) for c in (1, 2)), pa.array(out[3], pa.int64()), pa.array(np.concatenate(out[4]))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(out[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, end: int = 0, with_ids: bool = False, ranks: tuple[str, str] | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (always 0), bucket.

    `longest` is a power of two. A document's ids are those of its text (null: empty)
    with `end` after them. `bucket` is the binary logarithm of the length; with_ids adds
    the ids. sequence_id is unique: above, the bucket, then the place of the row, so that
    the sequences of a bucket are neighbours and follow the order of docs. Repeated rows
    and null doc_ids are documents of their own. No shuffle: each document is cut where it
    is read.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = _PIECES + (", ids array<int>" if with_ids else "")
    pieces = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lambda it: _cut(it, tokenizer, ranks, longest, end, with_ids), kind)
    bucket = F.log2(F.col("length")).cast("int")
    # The row's place has its partition above 33 bits; 58 bits leave room for 2 ** 25 partitions.
    return pieces.withColumns({"bucket": bucket, "sequence_id": F.shiftleft(bucket.cast("bigint"), 58) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
