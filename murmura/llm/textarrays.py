"""Words, lines and their 64-bit hashes for whole Arrow batches, in numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  UTF-8 keeps all
bytes of longer characters at 0x80 and above, so cutting bytes cuts the same
words as cutting characters.  Nothing here keeps state between batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed together; a longer document stands alone.
CHUNK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; equal inputs only give equal outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the ``len + 1`` offsets; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges ``(a, b)`` of at most ``limit`` bytes, or of one row."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


class TextArrays:
    """Makes the arrays of a chunk; holds the powers of the hash's base."""

    def __init__(self):
        self.white = np.zeros(256, bool)
        self.white[[0x20, 9, 10, 11, 12, 13]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.kind = np.full(256, 2, np.uint8)
        self.kind[self.white] = 0
        self.kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.up = np.full(n, BASE, np.uint64)
        self.down = np.full(n, BASE_INVERSE, np.uint64)
        self.up[0] = self.down[0] = 1
        np.cumprod(self.up, out=self.up)
        np.cumprod(self.down, out=self.down)

    def span_hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of ``data[starts[i]:ends[i]]`` for each i."""
        n = len(data)
        if n + 1 > len(self.up):
            self._grow(max(n + 1, CHUNK_BYTES + 1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and row numbers of all words, in text order."""
        solid = ~self.white[data]
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        inner = off[:-1][off[:-1] < len(data)]
        before[inner] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(off, starts, "right") - 1

    def tokens(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Like ``words``, but runs of letters, digits and longer characters end where symbols begin."""
        kind = self.kind[data]
        new = np.ones(len(data), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[off[:-1][off[:-1] < len(data)]] = True
        edge = np.flatnonzero(new)
        ends = np.append(edge[1:], len(data))[: len(edge)]
        solid = kind[edge] > 0
        starts = edge[solid]
        return starts, ends[solid], np.searchsorted(off, starts, "right") - 1

    def batches(self, column: pa.Array, lower: bool = False):
        """``(first row, number of rows, bytes, offsets)`` of each chunk of a column."""
        data, off = text_bytes(column)
        for a, b in chunks(off):
            part = data[off[a] : off[b]]
            yield a, b - a, (self.lower[part] if lower else part), off[a : b + 1] - off[a]


def shingle_hashes(h: np.ndarray, row: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width``-word windows and their offsets by row.

    A row with fewer words, but one at least, has its whole sequence as its
    only window.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    windows = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(windows)])
    out = np.zeros(off[-1], np.uint64)

    def combine(at: np.ndarray, m: int) -> np.ndarray:
        acc = np.full(len(at), np.uint64(m), np.uint64)
        for j in range(m):
            acc = mix(acc * np.uint64(BASE) + h[at + j])
        return acc

    full = np.flatnonzero(count >= width)
    if len(full):
        size = windows[full]
        at = np.repeat(first[full] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        to = np.repeat(off[full] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
        out[to] = combine(at, width)
    for m in range(1, width):
        short = np.flatnonzero(count == m)
        if len(short):
            out[off[short]] = combine(first[short], m)
    return out, off
