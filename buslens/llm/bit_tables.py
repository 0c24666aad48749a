"""Bit tables of word sets, compared for many pairs at once: they bound what two sets have in common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Numbers that one comparison holds at a time.
STEP = 1 << 20


def set_tables(words: np.ndarray, first: np.ndarray) -> pa.Array:
    """One table per set; sets lie one after the other and start at `first`. Word w sets bit w modulo the size of the table, which is the power of two of
    at least two bits a word, 64 at least. A large table folds into a small one by halves."""
    size = np.diff(np.append(first, len(words)))
    bits = np.int64(1) << np.maximum(6, np.ceil(np.log2(2 * size)).astype("int64"))
    offsets = np.zeros(len(first) + 1, dtype="int32")
    np.cumsum(bits // 8, out=offsets[1:])
    out = np.zeros(int(offsets[-1]) // 8, dtype="uint64")
    own = np.repeat(np.arange(len(first)), size)
    at = (words & (bits[own] - 1).astype("uint64")).astype("int64")
    np.bitwise_or.at(out, offsets[own] // 8 + (at >> 6), np.uint64(1) << (at & 63).astype("uint64"))
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


class Tables:
    """A column of tables (set_tables): `words` holds 64 bits a piece, table i those from `start[i]` on, `count[i]` of them."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], dtype="int32")[column.offset:column.offset + len(column) + 1].astype("int64")
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype="uint8")[offsets[0]:offsets[-1]] if len(column) and raw is not None else np.zeros(0, "uint8")
        self.words = np.frombuffer(data.tobytes(), dtype="uint64")
        self.start = (offsets[:-1] - offsets[0]) // 8
        self.count = np.diff(offsets) // 8

    def folded(self, rows: np.ndarray, count: int, to: int) -> np.ndarray:
        """Tables of rows that have `count` words, as `to` words each."""
        found = self.words[self.start[rows][:, None] + np.arange(count)]
        return np.bitwise_or.reduce(found.reshape(len(rows), count // to, to), axis=1)

    def small(self, larger: np.ndarray) -> np.ndarray:
        """64 bits of each table: all words, or of larger sets, whose bits would be nearly all set, the words with bit 6 only."""
        if not len(self.count):
            return np.zeros(0, "uint64")
        place = np.arange(len(self.words)) - np.repeat(self.start, self.count)
        own = np.repeat(larger, self.count)
        return np.bitwise_or.reduceat(np.where(own & (place & 1 == 0), np.uint64(0), self.words), self.start)


def room(a: Tables, x: np.ndarray, size_a: np.ndarray, b: Tables, y: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """For each pair of rows x of a and y of b: no more words than that are in both sets. Each bit that only one table has is a word that the other set lacks."""
    out = np.zeros(len(x), dtype="int64")
    kinds = a.count[x] * (1 << 32) + b.count[y]
    for kind in np.unique(kinds):
        n, m = int(kind) >> 32, int(kind) & 0xFFFFFFFF
        rows = np.flatnonzero(kinds == kind)
        for part in _parts(rows, max(1, STEP // max(n, m))):
            p, q = a.folded(x[part], n, min(n, m)), b.folded(y[part], m, min(n, m))
            only_a, only_b = (np.bitwise_count(u & ~v).sum(axis=1, dtype="int64") for u, v in ((p, q), (q, p)))
            out[part] = np.minimum(size_a[part] - only_a, size_b[part] - only_b)
    return out


def _parts(rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    for i in range(0, len(rows), size):
        yield rows[i:i + size]
