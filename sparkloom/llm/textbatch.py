"""Vectorised views of Arrow text columns for use inside Spark tasks.

Text stays in its UTF-8 Arrow buffer; words, lines, windows and their 64-bit hashes are numpy
arrays over that buffer, so no Python object is made per word. Batches are cut into slices of
about ``SLICE_BYTES`` bytes (always whole documents), which bounds a task's memory by that
figure or by the longest single text. A null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: Longer byte ranges are hashed by BLAKE2: texts can be made up on which a sum of powers collides, but only long ones.
LONG_RANGE = 255

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``limit`` bytes each, one row at least."""
    sizes = _offsets(texts)[1]
    lo, n = 0, len(sizes) - 1
    while lo < n:
        hi = int(np.searchsorted(sizes, sizes[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _offsets(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    flat = texts.cast(pa.large_string())
    if flat.null_count:
        flat = flat.fill_null("")
    raw = flat.buffers()[1]
    if raw is None or len(flat) == 0:
        return flat, np.zeros(len(flat) + 1, np.int64)
    return flat, np.frombuffer(raw, np.int64)[flat.offset : flat.offset + len(flat) + 1]


class TextBatch:
    """The words, lines and hashes of a slice of texts.

    data      bytes of all texts, one after the other
    docs      offsets of the texts in ``data`` (one more than texts)
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        flat, offsets = _offsets(texts)
        self.n = len(flat)
        lo, hi = int(offsets[0]), int(offsets[-1])
        body = flat.buffers()[2] if self.n else None
        self.data = np.frombuffer(body, np.uint8)[lo:hi] if body is not None and hi > lo else np.zeros(0, np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.docs = np.asarray(offsets - lo, np.int64)
        self._sums: np.ndarray | None = None

    def runs(self, inside: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of true bytes that cross neither a text's border nor a cut."""
        n = len(inside)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        borders = self.docs[1:-1]
        borders = borders[(borders > 0) & (borders < n)]
        for edge in (borders, cuts) if cuts is not None else (borders,):
            before[edge] = False
            after[edge - 1] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (without \\n) and text index of every \\n-split line; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        owner = self.owner(breaks)
        starts = np.concatenate([self.docs[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.docs[1:]])
        doc_s = np.concatenate([np.arange(self.n), owner])
        doc_e = np.concatenate([owner, np.arange(self.n)])
        by_start = np.lexsort((np.concatenate([np.zeros(self.n), np.ones(len(breaks))]), starts, doc_s))
        by_end = np.lexsort((np.concatenate([np.zeros(len(breaks)), np.ones(self.n)]), ends, doc_e))
        return starts[by_start], ends[by_end], doc_s[by_start]

    def owner(self, at: np.ndarray) -> np.ndarray:
        """Index of the text that holds each byte position."""
        return np.searchsorted(self.docs, at, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges: equal bytes, equal hash, wherever they stand."""
        n = len(self.data)
        up, down = powers(n + 1)
        if self._sums is None:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            self._sums = sums
        out = mix64((self._sums[ends] - self._sums[starts]) * down[starts] + np.uint64(1))
        for i in np.flatnonzero(ends - starts > LONG_RANGE).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def code_points(self) -> np.ndarray:
        """Number of code points before each byte position (one more entry than bytes)."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def count_in(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many true entries of mask lie in each [start, end)."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[ends] - sums[starts]


def windows(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and the hash of every k-word window that stays in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(owner[:n] == owner[k - 1 :])
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc = acc * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
    return first, mix64(acc[first] + np.uint64(k))
