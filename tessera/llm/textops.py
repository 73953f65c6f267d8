"""Vectorised word segmentation and hashing over Arrow string columns (numpy on UTF-8 bytes)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]  # powers of the base and of its inverse

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: bytes between the letter-and-digit runs of a text (every non-ASCII byte counts as a letter)
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words: flips of one bit spread over all."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = 1 << max(18, (n - 1).bit_length())
        for k, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            p = np.full(m, U(base), U)
            p[0] = U(1)
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def slices(col, limit: int = 1 << 18):
    """Row ranges (start, stop) of a string column holding about `limit` bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, done, n = 0, 0, len(sizes)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])


def raw(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """Words of a string column: maximal runs of bytes that are no ASCII white space.

    start, stop: byte positions; row: the row of each word; first: index of each row's first
    word (len rows + 1).
    """

    def __init__(self, col, lower: bool = False, breaks: np.ndarray = SPACE):
        self.data, self.off = raw(col)
        b = self.data
        space = breaks[b]
        begin = ~space
        begin[1:] &= space[:-1]
        edges = self.off[:-1][self.off[:-1] < len(b)]
        begin[edges] = ~space[edges]
        finish = ~space
        finish[:-1] &= space[1:]
        last = self.off[1:][self.off[1:] > 0] - 1
        finish[last] = ~space[last]
        self.start = np.flatnonzero(begin)
        self.stop = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.row = np.repeat(np.arange(len(self.off) - 1), np.diff(self.first))
        if lower:
            self.data = LOWER[b]
        self._sum = None

    def hashes(self, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word (or of the given byte ranges)."""
        n = len(self.data)
        p, q = powers(n + 1)
        if self._sum is None:
            self._sum = np.zeros(n + 1, U)
            np.cumsum((self.data.astype(U) + U(1)) * p[:n], out=self._sum[1:])
        start = self.start if start is None else start
        stop = self.stop if stop is None else stop
        return mix((self._sum[stop] - self._sum[start]) * q[start] + (stop - start).astype(U))


def shingles(w: Words, k: int = 3) -> list[np.ndarray]:
    """Per row, the sorted distinct hashes of its k-word shingles; a row of fewer words gives its whole sequence, one of none nothing."""
    h = w.hashes()
    n = len(h)
    if n >= k:
        g = h[: n - k + 1].copy()
        for j in range(1, k):
            g = mix(g * U(0x9FB21C651E98DF25) + h[j : n - k + 1 + j])
    out = []
    for r in range(len(w.first) - 1):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            x = h[a : a + 1].copy()
            for j in range(a + 1, b):
                x = mix(x * U(0x9FB21C651E98DF25) + h[j : j + 1])
            out.append(mix(x + U(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
