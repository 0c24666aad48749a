"""Packing documents into token sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from buslens.llm.common import filtered, key_filter, pick, same_keys_join, staged
from buslens.llm.tokens import WordTokens, tokenizer_path

#: Tokens of a sequence.
WINDOW = 2048
#: The id after each document.
END_ID = 1
#: Combinations of three lengths that are tried, those with the most pieces first. What no combination takes is packed as well.
TRIPLES = 8_192
#: Rounds of coordinate descent.
SWEEPS = 30


def combinations(counts: np.ndarray, triples: int = TRIPLES) -> list[tuple[int, ...]]:
    """Two or three lengths that fill a window and that pieces have. counts: pieces by length, 0 to window - 1."""
    window = len(counts)
    have = np.flatnonzero(counts)
    found: list[tuple[int, ...]] = [(int(a), int(window - a)) for a in have if 2 * a <= window and counts[window - a]]
    rows = []
    for a in have:
        b = have[have >= a]
        c = window - a - b
        ok = (c >= b) & (c > 0)
        b, c = b[ok], c[ok]
        ok = counts[c] > 0
        if ok.any():
            rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    if rows:
        all_rows = np.concatenate(rows)
        least = counts[all_rows].min(axis=1)
        found += [tuple(map(int, x)) for x in all_rows[np.argsort(-least, kind="stable")[:triples]]]
    return found


def repeat_counts(counts: np.ndarray, combos: list[tuple[int, ...]], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares: how often each combination is used so that the uses of each length come near its count.
    Coordinate descent; a combination's column holds how often it has each length."""
    left = [float(x) for x in counts]
    used = [0.0] * len(combos)
    columns = [[(x, combo.count(x)) for x in sorted(set(combo))] for combo in combos]
    squares = [sum(m * m for _, m in column) for column in columns]
    for _ in range(sweeps):
        moved = 0.0
        for i, column in enumerate(columns):
            step = sum(m * left[x] for x, m in column) / squares[i]
            if step < -used[i]:
                step = -used[i]
            if step:
                used[i] += step
                moved = max(moved, abs(step))
                for x, m in column:
                    left[x] -= m * step
        if moved < 0.01:
            break
    return used


def greedy(left: list[int]) -> list[tuple[list[int], int]]:
    """Full windows from the pieces that are left, which it takes from `left`: the longest first, each time the longest that fits or
    the one that just fills up. Each pattern is used as often as there are pieces for it. Lengths that fill no window stay."""
    window, patterns = len(left), []
    have = [x for x in range(1, window) if left[x]]
    skipped = 0  # the longest lengths, for which no full window was found
    while len(have) > skipped:
        room, lengths, used = window, [], {}
        while room:
            x = room if room < window and left[room] > used.get(room, 0) else 0
            if not x:
                at = min(bisect_right(have, room), len(have) - skipped) - 1
                while at >= 0 and left[have[at]] <= used.get(have[at], 0):
                    at -= 1
                if at < 0:
                    break
                x = have[at]
            lengths.append(x)
            used[x] = used.get(x, 0) + 1
            room -= x
        if room:
            skipped += 1
            continue
        n = min(left[x] // m for x, m in used.items())
        patterns.append((lengths, n))
        for x, m in used.items():
            left[x] -= n * m
        longest = have[len(have) - skipped:]
        have = [x for x in have[:len(have) - skipped] if left[x]]
        have += [x for x in longest if left[x]]
        skipped = sum(1 for x in longest if left[x])
    return patterns


@dataclass
class Plan:
    """Where the i-th piece of each length goes: `slots` rows are (length, first i, end i, first sequence, offset); from `rest[length]`
    on, pieces lie one after the other from place `place[length]` of a stream of `total` tokens, which starts at `stream`."""
    slots: np.ndarray
    rest: np.ndarray
    place: np.ndarray
    total: int
    stream: int


def plan(counts: np.ndarray, first: int, triples: int = TRIPLES) -> Plan:
    """counts: pieces by length below the window; first: the first free sequence. Its size is bounded by the window, not the data."""
    combos = combinations(counts, triples)
    wanted = repeat_counts(counts, combos)
    left = [int(x) for x in counts]
    order = sorted(range(len(combos)), key=lambda i: (-wanted[i], i))
    uses = [0] * len(combos)

    def room(combo: tuple[int, ...]) -> int:
        return min(left[x] // combo.count(x) for x in set(combo))

    for most in (lambda i: int(wanted[i] + 0.5), lambda i: left[combos[i][0]]):  # rounded counts, then what still fits
        for i in order:
            n = min(most(i), room(combos[i]))
            if n > 0:
                uses[i] += n
                for x in combos[i]:
                    left[x] -= n
    patterns = [(sorted(combo, reverse=True), uses[i]) for i, combo in enumerate(combos) if uses[i]]
    patterns += greedy(left)
    slots, taken, sequence = [], [0] * len(counts), first
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            slots.append((x, taken[x], taken[x] + n, sequence, offset))
            taken[x] += n
            offset += x
        sequence += n
    rest = np.array(left, dtype="int64")
    # The rest lies in a stream, longest first: greedy, and cut where a window ends.
    tokens = rest * np.arange(len(rest))
    place = np.cumsum(tokens[::-1])[::-1] - tokens
    return Plan(np.array(sorted(slots), dtype="int64").reshape(-1, 5), np.array(taken, dtype="int64"), place, int(tokens.sum()), sequence)


def stream_cuts(begin: int, length: int, total: int, window: int) -> list[tuple[int, int, int, int]]:
    """(from, length, sequence, offset) of the parts of a piece at `begin` of the stream. What follows the last whole window is
    cut into powers of two, largest first, which need no padding."""
    whole = total // window * window
    out, at, end = [], begin, begin + length
    while at < end:
        if at < whole:
            low, high, number = at // window * window, at // window * window + window, at // window
        else:
            low, high, number = whole, whole, whole // window - 1
            for bit in reversed(range(window.bit_length())):
                if (total - whole) >> bit & 1 and high <= at:
                    low, high, number = high, high + (1 << bit), number + 1
        stop = min(end, high)
        out.append((at - begin, stop - at, number, at - low))
        at = stop
    return out


def _tokenized(path: str, window: int, end_id: int):
    """Pieces of one window, and the rest, of each document: doc_id, mark, start, length, ids_crc32, doc_tokens, block, nth (of
    its length in the block)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, size, block = WordTokens.of(path), 4 * window, TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        last = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for i, parts in enumerate(model.texts(batch.column("text"))):
                held, crcs = b"", []
                for ids in _ended(parts, last):
                    held += ids
                    whole = len(held) // size * size
                    crcs += [zlib.crc32(held[k:k + size]) for k in range(0, whole, size)]
                    held = held[whole:]
                tokens = len(crcs) * window + len(held) // 4
                for k, crc in enumerate(crcs):
                    rows.append((i, k * window, window, crc, tokens, seen[window]))
                    seen[window] += 1
                if held:
                    n = len(held) // 4
                    rows.append((i, len(crcs) * window, n, zlib.crc32(held), tokens, seen[n]))
                    seen[n] += 1
            at, *numbers = [np.array(c, dtype="int64") for c in zip(*rows)] if rows else [np.zeros(0, "int64")] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), batch.column("mark").take(pa.array(at)), *map(pa.array, numbers[:4]), pa.array(np.full(len(at), block)), pa.array(numbers[4])],
                                             names=["doc_id", "mark", "start", "length", "ids_crc32", "doc_tokens", "block", "nth"])
            pa.default_memory_pool().release_unused()  # workers outlive their tasks
    return cut


def _ended(parts: Iterable[bytes], last: bytes) -> Iterator[bytes]:
    yield from parts
    yield last


def _placed(found: Plan, window: int):
    """The plan applied: a piece's part or parts, with sequence and offset; ids_crc32 is NULL for a part of a cut piece."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = found.slots[:, 0]
        keys = lengths * (1 << 48) + found.slots[:, 2]  # by length, then end
        for batch in batches:
            length, rank, start = (batch.column(c).to_numpy() for c in ("length", "rank", "start"))
            n = len(length)
            sequence, offset = rank.copy(), np.zeros(n, "int64")
            part = length < window
            loose = part & (rank >= found.rest[np.where(part, length, 0)])
            slot = part & ~loose
            if slot.any():
                at = np.searchsorted(keys, length[slot] * (1 << 48) + rank[slot], side="right")
                sequence[slot] = found.slots[at, 3] + rank[slot] - found.slots[at, 1]
                offset[slot] = found.slots[at, 4]
            rows = [(int(i), s, m, q + found.stream, o) for i in np.flatnonzero(loose)
                    for s, m, q, o in stream_cuts(int(found.place[length[i]] + (rank[i] - found.rest[length[i]]) * length[i]), int(length[i]), found.total, window)]
            extra = [np.array(c, dtype="int64") for c in zip(*rows)] if rows else [np.zeros(0, "int64")] * 5
            kept = np.flatnonzero(~loose)
            at = np.concatenate([kept, extra[0]])
            own = np.concatenate([length[kept], extra[2]])
            out = batch.select(["doc_id", "mark", "ids_crc32", "doc_tokens"]).take(pa.array(at))
            crc = pa.array(out.column("ids_crc32").to_numpy(), mask=own != length[at])
            yield pa.RecordBatch.from_arrays(
                [out.column("doc_id"), out.column("mark"), pa.array(start[at] + np.concatenate([np.zeros(len(kept), "int64"), extra[1]])), pa.array(own), crc, out.column("doc_tokens"),
                 pa.array(np.concatenate([sequence[kept], extra[3]])), pa.array(np.concatenate([offset[kept], extra[4]]))],
                names=["doc_id", "mark", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return place


def _summed(path: str, end_id: int):
    """ids_crc32 of parts, from their documents' texts."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordTokens.of(path)
        for batch in batches:
            crcs = []
            for parts, start, length in zip(model.texts(batch.column("text")), batch.column("start").to_pylist(), batch.column("length").to_pylist()):
                ids = b"".join(_ended(parts, end_id.to_bytes(4, "little")))
                crcs.append(zlib.crc32(ids[4 * start:4 * (start + length)]))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([pa.array(crcs, pa.int64()) if n == "ids_crc32" else batch.column(n) for n in names], names=names)
    return add


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, tokenizer: str | None = None, triples: int = TRIPLES) -> DataFrame:
    """All documents in sequences of at most `window` tokens: one row per piece, with doc_id, start (its document's ids before
    it), length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's ids end with `end_id`. Whole windows of a document are sequences of their own; the rest of it is a piece shorter
    than a window. Only the number of pieces by length, at most `window` numbers, goes to the driver: it enumerates pairs and
    triples of lengths that fill a window, solves for their repeat counts, rounds them and fits in what is left. The
    pieces that remain follow each other in a stream, cut at window ends, so that no sequence needs padding: the last tokens are
    cut into powers of two. The i-th piece of a length finds its place from the plan by its number alone.

    NULL and empty texts are the end id alone. Rows repeated in full are packed each. A NULL doc_id stays NULL. An empty table gives
    no rows. Only a document that the stream cuts is tokenized twice.
    """
    path = tokenizer_path(tokenizer)
    docs = pick(docs, "doc_id", "text").withColumn("mark", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = staged(docs.mapInArrow(_tokenized(path, window, end_id), f"doc_id {kind}, mark long, start long, length long, ids_crc32 long, doc_tokens long, block long, nth long"), "pieces")
    per_block = pieces.groupBy("length", "block").count()
    ahead = staged(per_block.select("length", "block", "count", F.expr("coalesce(sum(count) over (partition by length order by block rows between unbounded preceding and 1 preceding), 0L)").alias("ahead")), "ahead")
    counts = np.zeros(window, dtype="int64")
    whole = 0
    for length, n in ahead.groupBy("length").agg(F.sum("count")).collect():  # at most `window` rows
        if length == window:
            whole = n
        else:
            counts[length] = n
    found = plan(counts, whole, triples)
    ranked = pieces.join(ahead.select("length", "block", "ahead"), ["length", "block"]).withColumn("rank", F.col("nth") + F.col("ahead")).drop("ahead", "nth", "block")
    schema = f"doc_id {kind}, mark long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = staged(ranked.mapInArrow(_placed(found, window), schema), "placed")
    parts = staged(placed.where("ids_crc32 IS NULL"), "parts")
    # Shuffled, whatever the size: two Python steps in one task would hold two workers, and each executor keeps them from then on.
    texts = same_keys_join(filtered(docs, "mark", key_filter(parts.select("mark"))), parts.hint("merge"), ["doc_id", "mark"])
    summed = texts.select("text", *parts.columns).mapInArrow(_summed(path, end_id), schema).dropDuplicates(["sequence_id", "offset"])
    return placed.where("ids_crc32 IS NOT NULL").unionByName(summed).drop("mark")
