"""Lists of set ids by prefix element: shared steps of the exact set-similarity joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts(keys: list[np.ndarray]) -> np.ndarray:
    """Places where sorted key columns change."""
    changes = np.ones(len(keys[0]), dtype=bool)
    changes[1:] = False
    for k in keys:
        changes[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changes)


def runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of whole keys (the first `keys` columns), from rows sorted by them. Holds the longest list of a key."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns)]
        if not len(columns[0]):
            continue
        cut = int(starts(columns[:keys])[-1])
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held


def earliest_partners(begins: np.ndarray, counts: np.ndarray, may_link, block: int = 2_048, kinds: np.ndarray | None = None, kinds_may_link=None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the lists, the first row before it in its list that it may link with (or -1), and whether it may link with any
    row at all. may_link takes two arrays of row numbers. Short lists are compared shift by shift, all at once; long ones in blocks,
    and only rows of kinds that may link with a kind in the list: rows of one kind are alike to kinds_may_link."""
    n = int(counts.sum())
    earliest, some = np.full(n, -1), np.zeros(n, dtype=bool)
    depth = np.arange(n) - np.repeat(begins, counts)
    at = np.flatnonzero(np.repeat(counts <= 64, counts) & (depth > 0))
    shift = 1
    while len(at):
        ok = at[may_link(at, at - shift)]
        earliest[ok] = ok - shift
        some[ok] = some[ok - shift] = True
        shift += 1
        at = at[depth[at] >= shift]
    for s, m in zip(begins[counts > 64], counts[counts > 64]):
        rows = np.arange(s, s + m)
        if kinds is not None:
            _, one, back = np.unique(kinds[s:s + m], return_index=True, return_inverse=True)
            rows = rows[kinds_may_link(s + one[:, None], s + one[None, :]).any(axis=1)[back]]
        for i in range(0, len(rows), 256):
            x = rows[i:i + 256, None]
            for j in range(0, min(i + 256, len(rows)), block):
                y = rows[j:min(j + block, i + 256)]
                ok = may_link(x, y) & (y < x)
                hit = ok.any(axis=1)
                new = hit & (earliest[x[:, 0]] < 0)
                earliest[x[new, 0]] = y[ok[new].argmax(axis=1)]
                some[x[hit, 0]] = True
                some[y[ok.any(axis=0)]] = True
    return earliest, some


def set_sketch(found: np.ndarray) -> bytes:
    """A bit table of a set, of at least three quarters of a bit for each element: it bounds what two sets have in common."""
    size = 1 << max(6, int(np.ceil(np.log2(0.75 * len(found)))))
    bits = np.zeros(size, dtype=bool)
    bits[(found & np.uint64(size - 1)).astype("int64")] = True
    return np.packbits(bits).tobytes()


def most_common(a: bytes, size_a: int, b: bytes, size_b: int) -> int:
    """No more elements than that are in both sets: each bit that only one of them has is an element that the other lacks."""
    x, y = (np.unpackbits(np.frombuffer(s, dtype="uint8")).astype(bool) for s in (a, b))
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    return min(size_a - int((x & ~y).sum()), size_b - int((y & ~x).sum()))
