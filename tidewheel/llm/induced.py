"""External induced suffix sorting with common-prefix values.

Suffixes are induced from the sorted minima (positions whose suffix is smaller than both
neighbours') by a disk-backed priority queue: its tuples are (character, turn, position,
common prefix), ordered by character and then by the turn in which they were put in. A tuple
that is taken puts in the suffix one to its left; the two sweeps (upwards for suffixes larger
than their right neighbour, downwards for the others) put each suffix in once. The common
prefix of two suffixes put in one after the other for the same character is one more than the
least common prefix between the suffixes that they came from, which the queue's values tell.

The minima are sorted the same way: a first induction sorts the substrings between them, whose
places among one another are their names; the text of names, at most half as long, is sorted
recursively, by this very procedure, until all names differ or names are as long as asked.
The recursion's base is a text of names so short that doubling their ranks in memory does it.

Text, queues, names and every other array as long as the text are in memory up to `memory`
bytes each and lie in unnamed files of the task beyond that, so a text can be far larger than
memory. A lost executor's files are made anew by the task that is run again.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 32 << 20
#: Tuples that are taken from a queue at a time, about.
BLOCK = 1 << 17
#: Tuples of a range of characters, about, of a large alphabet; a character of a small one is a range of its own.
RANGE, SMALL = 8192, 1024
#: Bytes for each name in the recursion's base, about; it is taken where they fit into the memory given.
BASE = 24
#: Highest common-prefix value; a higher one stands for substrings equal to their ends.
MOST, EQUAL = 254, 255


def room(n: int, kind, memory: int = MEMORY) -> np.ndarray:
    """An array of zeros, in memory or (above `memory` bytes) in an unnamed file."""
    kind = np.dtype(kind)
    if n * kind.itemsize <= memory:
        return np.zeros(n, kind)
    file = tempfile.TemporaryFile()
    file.truncate(n * kind.itemsize)
    return np.memmap(file, kind, "r+", shape=(n,))


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first : last + 1] for each pair, by minima of runs whose lengths double; an empty range: EQUAL."""
    size = last - first + 1
    out = np.full(len(first), EQUAL, np.uint8)
    if not len(first):
        return out
    level = np.frexp(np.maximum(size, 1))[1] - 1
    runs, width = values, 1
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero((level == k) & (size > 0))
        if len(mine):
            out[mine] = np.minimum(runs[first[mine]], runs[last[mine] - width + 1])
        if len(runs) > width:
            runs = np.minimum(runs[:-width], runs[width:])
        width *= 2
    return out


class Text:
    """A text of characters below `letters`, each place's type (whether its suffix is smaller than the next), and where runs of a character end."""

    def __init__(self, text: np.ndarray, letters: int, memory: int):
        self.text, self.letters, self.memory, self.n = text, letters, memory, len(text)
        self.kind = np.int32 if self.n < 2**31 else np.int64
        self.small = room(self.n, bool, memory)
        then = False
        for end in range(self.n - 1, 0, -BLOCK):  # from the right; a run of equal characters is of the type of its end
            at = max(0, end - BLOCK)
            part = np.asarray(text[at : end + 1])
            up, down = part[1:] > part[:-1], part[1:] < part[:-1]
            last = np.minimum.accumulate(np.where(up | down, np.arange(len(up), dtype=np.int32), np.int32(len(up)))[::-1])[::-1]
            self.small[at:end] = np.append(up, then)[last]
            then = self.small[at]
        self.counts = [room(letters, np.int64, memory), room(letters, np.int64, memory)]  # of larger and smaller suffixes by character
        for at in range(0, self.n, BLOCK):
            part, small = np.asarray(text[at : at + BLOCK]), np.asarray(self.small[at : at + BLOCK])
            for kind, count in enumerate(self.counts):
                c, k = np.unique(part[small if kind else ~small], return_counts=True)
                count[c] += k

    def run(self, places: np.ndarray) -> np.ndarray:
        """Lengths of the runs of equal characters from places on, up to MOST."""
        out = np.ones(len(places), np.int64)
        live, c = np.arange(len(places)), self.text[places]
        for k in range(1, MOST):
            at = places[live] + k
            live = live[at < self.n]
            live = live[self.text[places[live] + k] == c[live]]
            if not len(live):
                break
            out[live] += 1
        return out

    def minima(self) -> np.ndarray:
        total = 0
        spots = room(self.n // 2 + 1, self.kind, self.memory)
        for at in range(0, self.n, BLOCK):
            small = np.asarray(self.small[max(0, at - 1) : at + BLOCK])
            found = np.flatnonzero(small[1:] & ~small[:-1]) + max(1, at)
            spots[total : total + len(found)] = found
            total += len(found)
        return spots[:total]

    def ranges(self) -> list[tuple[int, int]]:
        """Runs of characters with at most RANGE suffixes together, or a single character."""
        if self.letters <= SMALL:
            return [(c, c + 1) for c in np.flatnonzero(self.counts[0] + self.counts[1]).tolist()]
        out, start, size = [], 0, 0
        for at in range(0, self.letters, BLOCK):
            total = np.cumsum(np.asarray(self.counts[0][at : at + BLOCK]) + np.asarray(self.counts[1][at : at + BLOCK]))
            done = 0
            while done < len(total):
                base = int(total[done - 1]) if done else 0
                fits = int(np.searchsorted(total, base + RANGE - size, "right"))
                if fits >= len(total):
                    size += int(total[-1]) - base
                    break
                if at + fits == start:  # one character, whatever its number
                    out.append((start, start + 1))
                    start, size, done = start + 1, 0, fits + 1
                else:
                    out.append((start, at + fits))
                    start, size, done = at + fits, 0, fits
        if start < self.letters:
            out.append((start, self.letters))
        return out


class Queue:
    """The priority queue's store: tuples (position, common prefix) by range of characters, read in the order written; over `memory` bytes they spill."""

    def __init__(self, number: int, memory: int):
        self.parts: list[list] = [[] for _ in range(number)]
        self.memory, self.held, self.file, self.fresh = memory, 0, None, []

    def put(self, bucket: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.parts[bucket].append((positions, common))
        self.fresh.append((bucket, len(self.parts[bucket]) - 1))
        self.held += positions.nbytes + common.nbytes
        if self.held > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for b, i in self.fresh:
                if i < len(self.parts[b]) and isinstance(part := self.parts[b][i], tuple):
                    place = self.file.tell()
                    self.file.write(part[0].tobytes() + part[1].tobytes())
                    self.parts[b][i] = [place, len(part[0]), part[0].dtype]
            self.fresh, self.held = [], 0

    def get(self, bucket: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Parts from `first` on, about BLOCK tuples, and which comes next."""
        found, size, i = [], 0, first
        while i < len(self.parts[bucket]) and size < BLOCK:
            part = self.parts[bucket][i]
            if isinstance(part, list):
                self.file.seek(part[0])
                raw = self.file.read(part[1] * (part[2].itemsize + 1))
                part = np.frombuffer(raw, part[2], part[1]), np.frombuffer(raw, np.uint8, offset=part[1] * part[2].itemsize)
            else:
                self.held -= part[0].nbytes + part[1].nbytes
            self.parts[bucket][i] = None
            found.append(part)
            size += len(part[0])
            i += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint8), i
        return np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found]), i


class Sweep:
    """One sweep of an induction: suffixes of one type, in order, from those given and from one another.

    `down`: the sweep from the largest to the smallest, for suffixes of the smaller type;
    else upwards for the others. Results: `positions`, `common` (with the one before in the
    sweep; 0 where the character changes), in the order of the sweep.
    """

    def __init__(self, text: Text, down: bool, given: tuple[np.ndarray, np.ndarray, np.ndarray], whole: bool, seed: int | None = None):
        """given: (positions, common, number by character) in the order of the sweep; whole: given suffixes are sorted as such, not by their first characters."""
        self.t, self.down, self.whole, self.last_own, self.last_position = text, down, whole, False, 0
        self.given, self.given_common, self.given_count = given
        self.counts = text.counts[1 if down else 0]
        self.n = int(self.counts.sum())
        self.positions, self.common = room(self.n, text.kind, text.memory), room(self.n, np.uint8, text.memory)
        self.made = 0
        self.cuts = text.ranges()
        self.starts = np.array([a for a, _ in self.cuts], dtype=np.int64)
        self.queue = Queue(len(self.cuts), text.memory)
        # Of each character: the least common prefix since the last suffix was put in for it, and for which sweep step that holds.
        self.low, self.step = room(text.letters, np.uint8, text.memory), room(text.letters, np.int64, text.memory)
        self.now, self.touched = 0, np.zeros(0, np.int64)
        self.last = -1  # character of the last tuple taken
        if seed is not None:
            self.queue.put(self._range(int(text.text[seed])), np.array([seed], text.kind), np.zeros(1, np.uint8))
        self.at = 0
        for r in range(len(self.cuts) - 1, -1, -1) if down else range(len(self.cuts)):
            self._range_sweep(r)
        assert self.made == self.n and self.at == len(self.given), "an induction has lost suffixes"

    def _range(self, c: int) -> int:
        return int(np.searchsorted(self.starts, c, "right")) - 1

    def _range_sweep(self, r: int) -> None:
        low, high = self.cuts[r]
        if high - low == 1:
            first = True
            i = 0
            while i < len(self.queue.parts[r]):  # also what is put in meanwhile
                p, common, i = self.queue.get(r, i)
                if first:
                    common = common.copy()
                    common[0], first = 0, False
                self._own(p, common)
                self._take(p, common, np.full(len(p), low, np.int64))
            number = int(self.given_count[low])
            for at in range(self.at, self.at + number, BLOCK):
                p = np.asarray(self.given[at : min(at + BLOCK, self.at + number)])
                common = np.array(self.given_common[at : at + len(p)])
                if at == self.at:
                    common[0] = 0 if first else self._seam(self.positions[self.made - 1 : self.made], p[:1])[0]
                self._take(p, common, np.full(len(p), low, np.int64))
            self.at += number
            return
        number = int(np.asarray(self.given_count[low:high]).sum())
        given, common = np.asarray(self.given[self.at : self.at + number]), np.asarray(self.given_common[self.at : self.at + number])
        self.at += number
        sign = -1 if self.down else 1
        # The pool: tuples of the range by (character, own before given, turn).
        pool_p, pool_l = given, common
        pool_key = 2 * sign * self.t.text[given].astype(np.int64) + 1
        i = 0
        while True:
            p, l, i = self.queue.get(r, i)
            if len(p):
                key = np.concatenate([pool_key, 2 * sign * self.t.text[p].astype(np.int64)])
                pool_p, pool_l = np.concatenate([pool_p, p]), np.concatenate([pool_l, l])
                order = np.argsort(key, kind="stable")
                pool_key, pool_p, pool_l = key[order], pool_p[order], pool_l[order]
                continue
            if not len(pool_p):
                return
            # As many tuples as come before all that they put in.
            before = np.maximum(pool_p.astype(np.int64) - 1, 0)
            puts = (pool_p > 0) & (np.asarray(self.t.small[before]) == self.down)
            target = np.where(puts, 2 * sign * self.t.text[before].astype(np.int64), np.iinfo(np.int64).max)
            least = np.minimum.accumulate(target)
            end = int(np.argmax(pool_key > np.concatenate([[np.iinfo(np.int64).max], least[:-1]]))) or len(pool_key)
            p, l, key = pool_p[:end], pool_l[:end].copy(), pool_key[:end]
            pool_p, pool_l, pool_key = pool_p[end:], pool_l[end:], pool_key[end:]
            char, own = (key >> 1) * sign, key & 1 == 0
            new = np.concatenate([[char[0] != self.last], char[1:] != char[:-1]])
            l[new] = 0
            seam = np.flatnonzero(~own & ~new & np.concatenate([[self.last_own], own[:-1]]))
            if len(seam):
                left = np.where(seam > 0, p[seam - 1], self.last_position)
                l[seam] = self._seam(left, p[seam])
            self._own(p[own], l[own])
            self._take(p, l, char)
            self.last_own, self.last_position = bool(own[-1]), p[-1]

    def _seam(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Common prefixes where the types meet within a character: the shorter run of it; only the character itself for suffixes known by that alone."""
        if not self.whole:
            return np.ones(len(left), np.uint8)
        return np.minimum(self.t.run(left.astype(np.int64)), self.t.run(right.astype(np.int64))).astype(np.uint8)

    def _own(self, p: np.ndarray, common: np.ndarray) -> None:
        self.positions[self.made : self.made + len(p)] = p
        self.common[self.made : self.made + len(p)] = common
        self.made += len(p)

    def _take(self, p: np.ndarray, common: np.ndarray, char: np.ndarray) -> None:
        """Puts in the suffixes left of those at p, which come next in the sweep."""
        if not len(p):
            return
        goes_on = int(char[0]) == self.last
        if not goes_on:
            self.now, self.touched = self.now + 1, np.zeros(0, np.int64)
        self.last = int(char[-1])
        changes = np.flatnonzero(char[1:] != char[:-1]) + 1
        at = np.flatnonzero(p > 0)
        left = p[at] - 1
        mine = np.asarray(self.t.small[left]) == self.down
        at, left = at[mine], left[mine]
        target = self.t.text[left]
        tail = int(changes[-1]) if len(changes) else 0  # from where on the last character's tuples are
        if len(at):
            order = np.argsort(target, kind="stable")
            target, at, left = target[order].astype(np.int64), at[order], left[order]
            first = np.concatenate([[True], target[1:] != target[:-1]])
            value = np.zeros(len(at), np.uint8)
            again = np.flatnonzero(~first)
            value[again] = _least(common, at[again - 1] + 1, at[again])
            if goes_on:  # the first for a character: since an earlier block of the same step
                early = np.flatnonzero(first)
                early = early[np.asarray(self.step[target[early]]) == self.now]
                value[early] = np.minimum(_least(common, np.zeros(len(early), np.int64), at[early]), self.low[target[early]])
            value = np.where(value == EQUAL, EQUAL, np.minimum(value, MOST - 1) + 1).astype(np.uint8)
        if len(changes):
            self.now, self.touched = self.now + 1, np.zeros(0, np.int64)
        elif len(self.touched):
            self.low[self.touched] = np.minimum(self.low[self.touched], common.min())
        if len(at):
            final = np.flatnonzero(np.append(first[1:], True))
            final = final[at[final] >= tail]
            suffix = np.minimum.accumulate(common[::-1])[::-1]
            self.low[target[final]] = np.append(suffix, EQUAL)[at[final] + 1]
            self.step[target[final]] = self.now
            self.touched = np.union1d(self.touched, target[final]) if len(self.touched) else target[final]
            if self.t.letters <= SMALL:
                edges = np.flatnonzero(first)
                bucket = target
            else:
                bucket = np.searchsorted(self.starts, target, "right") - 1
                # Within a range of characters tuples keep the order of their turns, which the sort by character has undone.
                turn = np.lexsort((at, bucket))
                bucket, left, value = bucket[turn], left[turn], value[turn]
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            left = left.astype(self.t.kind, copy=False)
            which = bucket[edges] if self.t.letters > SMALL else np.searchsorted(self.starts, bucket[edges])
            for r, a, b in zip(which.tolist(), edges.tolist(), [*edges[1:].tolist(), len(bucket)]):
                self.queue.put(r, left[a:b], value[a:b])


def _induce(text: Text, seeds: np.ndarray, common: np.ndarray, whole: bool) -> tuple[Sweep, Sweep]:
    """Both sweeps from sorted minima (with their common prefixes)."""
    count = room(text.letters, np.int64, text.memory)
    for at in range(0, len(seeds), BLOCK):
        c, k = np.unique(text.text[np.asarray(seeds[at : at + BLOCK])], return_counts=True)
        count[c] += k
    up = Sweep(text, False, (seeds, common, count), whole, seed=text.n - 1)
    # Backwards: a value belongs to the pair of neighbours, and so to the other one of them.
    n = up.n
    back, back_common = room(n, text.kind, text.memory), room(n, np.uint8, text.memory)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK)
        back[n - end : n - at] = up.positions[at:end][::-1]
        back_common[n - end + 1 : n - at] = up.common[at + 1 : end][::-1]
        if end < n:
            back_common[n - end] = up.common[end]
    down = Sweep(text, True, (back, back_common, text.counts[0]), True)
    return up, down


def _ascending(text: Text, up: Sweep, down: Sweep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order, with the common prefix of each with the one before."""
    a, z = 0, down.n  # how far the larger types are given out, from the start, and the smaller ones, from the end

    def smaller(first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes first .. end of the downward sweep, turned round; the values are of pairs, so they shift."""
        common = np.append(np.asarray(down.common[first + 1 : end]), down.common[end] if end < down.n else 0).astype(np.uint8)
        return np.asarray(down.positions[first:end])[::-1], common[::-1]

    for low, high in text.ranges():
        k, m = (int(np.asarray(c[low:high]).sum()) for c in text.counts)
        if high - low == 1:
            for at in range(a, a + k, BLOCK):
                end = min(at + BLOCK, a + k)
                yield np.asarray(up.positions[at:end]), np.asarray(up.common[at:end])
            for end in range(z, z - m, -BLOCK):
                p, common = smaller(max(z - m, end - BLOCK), end)
                if end == z:
                    common = common.copy()
                    common[0] = down._seam(up.positions[a + k - 1 : a + k], p[:1])[0] if k else 0
                yield p, common
        elif k + m:
            p2, l2 = smaller(z - m, z)
            p, common = np.concatenate([up.positions[a : a + k], p2]), np.concatenate([up.common[a : a + k], l2])
            char = text.text[p].astype(np.int64)
            order = np.argsort(char, kind="stable")
            p, common, char, is_small = p[order], common[order], char[order], (np.arange(k + m) >= k)[order]
            new = np.concatenate([[True], char[1:] != char[:-1]])
            common[new] = 0
            seam = np.flatnonzero(~new & is_small & np.concatenate([[False], ~is_small[:-1]]))
            if len(seam):
                common[seam] = down._seam(p[seam - 1], p[seam])
            yield p, common
        a, z = a + k, z - m


def _sorted_minima(text: Text, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The minima in the order of their suffixes (those that agree in `reach` characters in any order), with common prefixes."""
    spots, n, memory = text.minima(), text.n, text.memory
    m = len(spots)
    if m < 2:
        return spots, np.zeros(m, np.uint8)
    # By first characters only, equal as far as they go: the induction sorts the substrings up to the next minimum.
    start, common = room(m, text.kind, memory), np.broadcast_to(np.uint8(EQUAL), (m,))
    count = room(text.letters, np.int64, memory)
    for at in range(0, m, BLOCK):
        c, k = np.unique(text.text[np.asarray(spots[at : at + BLOCK])], return_counts=True)
        count[c] += k
    place = room(text.letters, np.int64, memory)
    total = 0
    for at in range(0, text.letters, BLOCK):
        part = np.asarray(count[at : at + BLOCK])
        place[at : at + BLOCK] = total + np.cumsum(part) - part
        total += int(part.sum())
    for at in range(0, m, BLOCK):
        part = np.asarray(spots[at : at + BLOCK])
        order = np.argsort(text.text[part], kind="stable")
        c = text.text[part[order]].astype(np.int64)
        nth = np.arange(len(c)) - np.searchsorted(c, c)
        start[place[c] + nth] = part[order]
        last = np.flatnonzero(np.append(c[1:] != c[:-1], True))
        place[c[last]] += nth[last] + 1
    up, down = _induce(text, start, common, False)
    # Names by substrings: the places of minima in this order; between names, the common prefix.
    order, between = room(m, np.int64, memory), room(m, np.uint8, memory)
    done, open_ = 0, EQUAL
    for p, l in _ascending(text, up, down):
        at = np.flatnonzero(np.asarray(text.small[p]) & (p > 0) & ~np.asarray(text.small[np.maximum(p.astype(np.int64) - 1, 0)]))
        if len(at):
            low = np.minimum.reduceat(l[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            low[0] = min(int(low[0]), open_)
            order[done : done + len(at)] = np.searchsorted(spots, p[at])
            between[done : done + len(at)] = low
            done, open_ = done + len(at), EQUAL
            if at[-1] + 1 < len(l):
                open_ = int(l[at[-1] + 1 :].min())
        else:
            open_ = min(open_, int(l.min(initial=EQUAL)))
    del up, down, start
    between[0] = 0
    names = room(m, np.int32 if m < 2**31 else np.int64, memory)
    steps = room(m, np.uint8, memory)  # common prefix of each name with the one before
    name = -1
    for at in range(0, m, BLOCK):
        part = np.asarray(between[at : at + BLOCK])
        fresh = part != EQUAL
        own = name + np.cumsum(fresh)
        names[np.asarray(order[at : at + BLOCK])] = own
        steps[own[fresh]] = part[fresh]
        name = int(own[-1])
    found, common = room(m, text.kind, memory), room(m, np.uint8, memory)
    if name == m - 1 or reach < 2:  # all names differ, or nothing beyond them is asked
        nth = order
        child = np.where(np.asarray(between) == EQUAL, 1, 0) if name < m - 1 else None
    elif BASE * m <= memory:
        nth, child = _doubled(np.asarray(names), reach // 2 + 1)
    else:
        nth, child = room(m, text.kind, memory), room(m, np.uint8, memory)
        done = 0
        for p, l in _all(Text(names, name + 1, memory), reach // 2 + 1):
            nth[done : done + len(p)], child[done : done + len(p)] = p, l
            done += len(p)
    tree = _Ranges(steps[: name + 1], memory)
    deep = reach // 2 + 1  # so many equal names have at least `reach` characters
    for at in range(0, m, BLOCK):
        j = np.asarray(nth[at : at + BLOCK]).astype(np.int64)
        found[at : at + len(j)] = spots[j]
        i = np.concatenate([[j[0]], j[:-1]]) if not at else np.concatenate([[int(nth[at - 1])], j[:-1]])
        h = np.asarray(child[at : at + BLOCK]).astype(np.int64) if child is not None else np.zeros(len(j), np.int64)
        value = np.full(len(j), MOST, np.int64)
        if not at:
            value[0] = 0
        some = np.flatnonzero((h < deep) & (np.maximum(i, j) + h < m) & (np.arange(len(j)) + at > 0))
        x, y = i[some] + h[some], j[some] + h[some]
        a, b = names[x].astype(np.int64), names[y].astype(np.int64)
        part = tree.least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)
        here = spots[y].astype(np.int64)
        lengths = [np.where(k + 1 < m, spots[np.minimum(k + 1, m - 1)].astype(np.int64), n - 1) - spots[k] + 1 for k in (x, y)]
        # Where one name is the start of the other but for the last type: the runs that begin there tell.
        ends = np.flatnonzero((part >= np.minimum(*lengths)) & (part < MOST) & (a != b))
        if len(ends):
            off = part[ends] - 1
            part[ends] = off + np.minimum(text.run(spots[x[ends]].astype(np.int64) + off), text.run(here[ends] + off))
        value[some] = np.minimum(here - spots[j[some]] + part, MOST)
        common[at : at + len(j)] = value
    return found, common


def _doubled(names: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a short text of names in order (those that agree in more than `deep` names in any), and common prefixes in names, by ranks of 1, 2, 4 ... names."""
    ranks, width = [names.astype(np.int64)], 1
    while True:
        rank = ranks[-1]
        ahead = np.zeros(len(rank), np.int64)
        ahead[: len(rank) - width] = rank[width:] + 1
        pair = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(pair, kind="stable")
        turned = pair[order]
        new = np.concatenate([[0], np.cumsum(turned[1:] != turned[:-1])])
        width *= 2
        if new[-1] == len(new) - 1 or width > deep:
            break
        rank = np.empty_like(new)
        rank[order] = new
        ranks.append(rank)
    common = np.zeros(len(order), np.int64)
    a, b, h = order[:-1], order[1:], common[1:]
    for rank in reversed(ranks):
        width //= 2
        x, y = a + h, b + h
        inside = np.flatnonzero(np.maximum(x, y) < len(rank))
        h[inside] += width * (rank[x[inside]] == rank[y[inside]])
    return order, np.minimum(common, MOST).astype(np.uint8)


class _Ranges:
    """Least values of ranges of names: minima of runs of doubling length, each as long an array as the names."""

    def __init__(self, steps: np.ndarray, memory: int):
        self.levels, width = [steps], 1
        while 2 * width <= len(steps):
            below, level = self.levels[-1], room(len(steps) - 2 * width + 1, np.uint8, memory)
            for at in range(0, len(level), BLOCK):
                end = min(len(level), at + BLOCK)
                level[at:end] = np.minimum(below[at:end], below[at + width : end + width])
            self.levels.append(level)
            width *= 2

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least step from name low (exclusive) to high."""
        out = np.full(len(low), MOST, np.uint8)
        size = high - low
        level = np.frexp(np.maximum(size, 1))[1] - 1
        for k in np.unique(level[size > 0]).tolist():
            mine = np.flatnonzero((level == k) & (size > 0))
            runs = self.levels[k]
            out[mine] = np.minimum(runs[low[mine] + 1], runs[high[mine] - (1 << k) + 1])
        return out


def _all(text: Text, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    minima, common = _sorted_minima(text, reach)
    up, down = _induce(text, minima, common, True)
    yield from _ascending(text, up, down)


def suffixes(text: np.ndarray, letters: int, reach: int = MOST, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (positions, common prefixes) of all suffixes of `text` (numbers below `letters`) in ascending order.

    A common prefix is that of a suffix with the one before, up to MOST. Suffixes that
    agree in `reach` characters (at most MOST) may come in any order, and their common
    prefix is at least `reach` then; others are exact.
    """
    if len(text):
        yield from _all(Text(text, letters, memory), min(reach, MOST))
