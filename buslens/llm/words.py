"""Words and word n-grams of Arrow text columns as 64-bit hashes, worked out for many texts at once.

A word is a run of bytes other than ASCII white space; A-Z count as a-z. Two different words of a corpus share a hash with a
chance of about n * n / 2**65 for n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one step works on, so that its arrays stay in the processor's cache; a longer text is worked on whole.
STEP_BYTES = 1 << 18


def _random(seed: int, n: int) -> np.ndarray:
    """n fixed odd 64-bit numbers (splitmix64)."""
    z = np.arange(1, n + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
_BYTE = _random(1, 256)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[SPACE] = 0
_PLACE = [_random(2 + i, 256) for i in range(4)]
for _far in _PLACE[1:]:
    _far[0] = 1  # a word hashes alike, whatever the length of others beside it
#: What a byte at a place (modulo 256) adds to its word.
_BYTE_AT = (_BYTE[:, None] * _PLACE[0][None, :]).ravel()
_GRAM = _random(11, 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hash_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte) of each word, and for each text the place of its first word. data: bytes of texts one after the
    other, which start and end at `cuts`."""
    word = (data != 32) & (data - np.uint8(9) > 4)
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    start[inner] = word[inner]
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, "uint64"), first, np.zeros(len(cuts), "int64")
    counts = np.diff(first, append=len(data))
    step = np.ones(len(data), dtype="uint8")  # sums of it are places in words, modulo 256; before the first word they don't matter
    step[first] = np.concatenate([-first[:1], 1 - counts[:-1]]).astype("uint8")
    values = _BYTE_AT.take((data.astype("uint16") << 8) | np.cumsum(step, dtype="uint8"))
    if counts.max() > 256:
        place = np.arange(len(data) - first[0]) - np.repeat(first - first[0], counts)
        for level in range(1, 4):
            values[first[0]:] *= _PLACE[level][(place >> (8 * level)) & 255]
    sums = np.cumsum(values)[np.append(first[1:], len(data)) - 1]
    sums[1:] -= sums[:-1].copy()
    return mix(sums), first, np.searchsorted(first, cuts)


def steps(column: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, cuts) of runs of texts. NULL counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = "int64" if pa.types.is_large_string(column.type) else "int32"
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + n + 1].astype("int64")
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype="uint8") if raw is not None and raw.size else np.zeros(0, "uint8")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def grams(words: np.ndarray, begin: int, end: int, n: int) -> np.ndarray:
    """Hashes of the n-grams of words[begin:end], repeats included; with fewer words, one of the whole sequence."""
    count = end - begin
    if not count:
        return np.zeros(0, "uint64")
    if count < n:
        return mix((words[begin:end] * _GRAM[n:n + count]).sum(dtype="uint64", keepdims=True) + _GRAM[32 + count:33 + count])
    total = words[begin:end - n + 1] * _GRAM[0]
    for k in range(1, n):
        total = total + words[begin + k:end - n + 1 + k] * _GRAM[k]
    return mix(total)
