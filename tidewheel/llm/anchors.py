"""Content-chosen anchors: every string of WINDOW bytes has one, at the same place wherever the string occurs.

The anchor of a window is the least hash among its GRAM-byte substrings, the first of
several. Windows that follow one another mostly share it, so a text has about one anchor for
every thirty-five bytes; equal windows have equal anchors at equal distances.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
#: Bytes that are hashed at a time; places within them take PLACE bits of a sort key.
CHUNK, PLACE = 1 << 20, 23
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.default_rng(1).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _doubled(data: np.ndarray) -> dict[int, np.ndarray]:
    """Polynomial hashes of all substrings of 4, 32 and 64 bytes, by length, by doubling."""
    out, size = {1: _BYTES[data]}, 1
    while size < 64:
        h = out[size]
        out[2 * size] = h[: len(h) - size] * _power(size) + h[size:] if len(h) > size else h[:0]
        if size not in (4, GRAM):  # the others are steps on the way
            del out[size]
        size *= 2
    return out


def of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, first, last, gram, context) of each anchor of documents whose bytes follow one another in `data`, each up to its end.

    first and last: the window starts whose anchor this is, from the document's start, as
    is place. gram hashes the anchor's bytes, context all bytes of its windows and where
    they lie around it.
    """
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = _doubled(data)
    gram = mix(hashes[GRAM])
    key = gram & ~np.uint64((1 << PLACE) - 1) | np.arange(len(gram), dtype=np.uint64)
    least, size = key, 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - size)], least[SPAN - size :])
    at = (least & np.uint64((1 << PLACE) - 1)).astype(np.int64)  # of window starts 0 .. n - WINDOW
    begins = np.concatenate([[0], ends[:-1]])
    doc = np.repeat(np.arange(len(ends)), ends - begins)[: len(at)]
    whole = np.arange(len(at)) + WINDOW <= ends[doc]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new & whole)
    change = np.flatnonzero(new | ~whole)
    last = np.append(change, len(at))[np.searchsorted(change, first, "right")] - 1
    place, doc = at[first], doc[first]
    h64, h32, h4 = hashes[64], hashes[32], hashes[4]

    def window(s: np.ndarray) -> np.ndarray:
        return h64[s] * _power(36) + h32[s + 64] * _power(4) + h4[s + 96]

    shape = ((place - first) << 8 | (place - last)).astype(np.uint64)
    context = mix(window(first) ^ mix(window(last) + np.uint64(0x632BE59BD9B4E019)) + shape * _BASE)
    start = begins[doc]
    return doc, place - start, first - start, last - start, gram[place], context
