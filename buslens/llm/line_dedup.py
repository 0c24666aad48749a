"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from buslens.llm.bit_tables import Tables, room, set_tables
from buslens.llm.common import combined, filtered, key_filter, may_hold, partitions, pick, same_keys_join, sorted_blocks, staged
from buslens.llm.prefix_lists import starts
from buslens.llm.words import hash_words, mix, steps

#: Lines link when 100 * common words >= PERCENT * all words of the two.
PERCENT = 80
#: Counters of word frequency; a fixed size at any input.
BITS = 22
PIECES = 64
#: Tasks that sum the counters up.
COUNT_TASKS = 16
#: Residual rows of one word that one task compares; longer lists are compared block against block.
LIST_BLOCK = 2_048
#: Of sets of more words than that, 64 bits stand for half of the words only.
SKETCHED = 85
#: Lists are dealt in so many parts at any input: were they more with every partition, packed rows would grow with the square of the input.
LIST_PARTS = 4_096
#: Postings that a task packs together, 28 bytes each: 64 a part. So packed rows grow with the postings.
PACKED = LIST_PARTS * 64
#: Postings of whole parts that a task looks at together; a larger part is looked at alone.
UNPACKED = 1 << 15
#: Pairs of a list that are looked at together.
PAIR_STEP = 1 << 18
#: How tables of hashes and bits are written: hardly a value repeats.
HASHES = {"parquet.enable.dictionary": "false"}
#: Later than every line.
NEVER = np.iinfo("int64").max


def word_classes(texts: DataFrame, bits: int = BITS) -> bytes:
    """Class of frequency of each of 2**bits word buckets over all texts: 0 for at most one word, else twice the logarithm."""
    size, piece = 1 << bits, (1 << bits) // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype="uint32")
        for batch in batches:
            for _, _, data, cuts in steps(batch.column(0)):
                np.add.at(total, (hash_words(data, cuts)[0] >> np.uint64(64 - bits)).astype("int64"), np.uint32(1))
        rows = total.reshape(PIECES, piece)
        used = [i for i in range(PIECES) if rows[i].any()]
        small = [rows[i].astype("uint8") if rows[i].max() < 256 else rows[i] for i in used]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "counts": pa.array([x.tobytes() for x in small], pa.binary())})

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[p] = sums.get(p, np.zeros(piece, "int64")) + np.frombuffer(raw, dtype="uint8" if len(raw) == piece else "uint32")
        out = [np.minimum(63, np.floor(2 * np.log2(np.maximum(x, 1)))).astype("uint8").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "classes": pa.array(out, pa.binary())})

    table = bytearray(size)
    counted = texts.mapInArrow(count, "piece int, counts binary").repartition(COUNT_TASKS, "piece").mapInArrow(classes, "piece int, classes binary")
    for row in counted.collect():  # 2**bits bytes in all
        table[row.piece * piece:(row.piece + 1) * piece] = row.classes
    return bytes(table)


def _prefix(size, percent: int):
    """Two linked sets share one of so many first words of each, in any common order."""
    return size - (percent * size + 99) // 100 + 1


def _line_sets(column: pa.Array, classes: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of lines with words: (text number, line number, first place, words), where the distinct words of each line lie one
    after the other in the global order, rare ones first."""
    split = pc.split_pattern(column, "\n")
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype("int64")
    text = np.repeat(np.arange(len(counts)), counts)
    line = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    for i, _, data, cuts in steps(split.flatten()):
        words, _, at = hash_words(data, cuts)
        own = np.repeat(np.arange(len(at) - 1, dtype="uint16" if len(at) < 65_536 else "int64"), np.diff(at))
        words = (classes[(words >> np.uint64(64 - bits)).astype("int64")].astype("uint64") << np.uint64(58)) | (words >> np.uint64(6))
        order = np.argsort(words)  # then by line; two plain sorts are faster than one by both
        order = order[np.argsort(own[order], kind="stable")]
        words, own = words[order], own[order]
        if not len(words):
            continue
        new = starts([own, words])
        words, own = words[new], own[new]
        first = starts([own])
        row = i + own[first].astype("int64")
        yield text[row], line[row], first, words


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per count of numbers."""
    offsets = np.zeros(len(counts) + 1, dtype="int32")
    np.cumsum(counts * values.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _sums(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell word sets apart: two sums of mixed words."""
    return tuple(np.add.reduceat(mix(words * np.uint64(c)), first).view("int64") for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _lines(table, percent: int, bits: int):
    """One row per line with words: where it is, its set's digest (d1, d2, size), its prefix as 32-bit keys, and its bit tables. Words whose bucket
    counts one word occur once in all texts, so no other line has them: they are left out of the prefix. Lines that have an earlier equal one in
    their batch are told from it here (size 0), and spread, so a line that very many texts have is a row a batch."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(table.value, dtype="uint8")
        for batch in batches:
            found = []
            for text, line, first, words in _line_sets(batch.column("text"), classes, bits):
                size = np.diff(np.append(first, len(words)))
                d1, d2 = _sums(words, first)
                where = [batch.column(c).take(pa.array(text)) for c in ("doc_id", "mark")]
                columns = [*where, pa.array(line), pa.array(d1), pa.array(d2), pa.array(size)]
                names = ["doc_id", "mark", "line", "d1", "d2", "size"]
                place = np.arange(len(words)) - np.repeat(first, size)
                # Fewer than four words: only an equal set is similar enough for the usual threshold, and needs no list.
                length = np.where(_partners(size, percent), _prefix(size, percent), 0)
                keep = (place < np.repeat(length, size)) & ((words >> np.uint64(58)) > 0)
                own = np.repeat(np.arange(len(first)), size)[keep]
                keys = (words[keep] >> np.uint64(32)).astype("uint32").view("int32")
                extra = [_binary(keys, np.bincount(own, minlength=len(first))), set_tables(words, first)]
                found.append(pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, "prefix", "sketch"]))
            if found:
                rows = pa.concat_batches(found)
                first, later = _first_lines(rows)
                yield rows.filter(pa.array(first))
                rows = rows.filter(pa.array(later))
                spread = pa.array(combined(rows.column("mark").to_numpy(), rows.column("line").to_numpy()))
                none, empty = pa.array(np.zeros(len(rows), "int64")), pa.nulls(len(rows), pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], spread, none, none, empty, empty], names=rows.schema.names)
    return build


def _first_lines(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the earliest of their set, and which are later. A row of the same place as the earliest is neither."""
    d1, d2, size = (rows.column(c).to_numpy() for c in ("d1", "d2", "size"))
    first, later = np.ones(len(d1), dtype=bool), np.zeros(len(d1), dtype=bool)
    order = np.argsort(d1, kind="stable")
    same = np.zeros(len(d1) + 1, dtype=bool)
    same[1:-1] = d1[order[1:]] == d1[order[:-1]]
    again = order[same[1:] | same[:-1]]
    if len(again):
        place = _places(rows.select(["doc_id", "mark", "line"]).take(pa.array(again)))
        at = np.lexsort([place, size[again], d2[again], d1[again]])
        again, place = again[at], place[at]
        begins = starts([d1[again], d2[again], size[again]])
        first[again] = False
        first[again[begins]] = True
        later[again] = place != np.repeat(place[begins], np.diff(np.append(begins, len(again))))
    return first, later


def _places(rows: pa.RecordBatch) -> np.ndarray:
    """Numbers of (doc_id, mark, line) in their order, a NULL doc_id last; equal ones share a number."""
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_id", "mark", "line")]).to_numpy()
    keys = [rows.column("doc_id").dictionary_encode("encode").indices.to_numpy(), rows.column("mark").to_numpy(), rows.column("line").to_numpy()]
    found = np.empty(len(order), dtype="int64")
    found[order] = _numbers([k[order] for k in keys])
    return found


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lines sorted by d1: the earliest of each set, and the places of the others with size 0."""
    names = ["doc_id", "mark", "line", "size", "prefix", "sketch"]
    for batch in _whole_keys(batches, ["d1"]):
        first, later = _first_lines(batch)
        yield batch.filter(pa.array(first)).select(names)
        rows = batch.filter(pa.array(later)).select(names)
        empty = pa.nulls(len(rows), pa.binary())
        yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(np.zeros(len(rows), "int64")), empty, empty], names=names)


def _partners(size: np.ndarray, percent: int) -> np.ndarray:
    """Whether a set of that size can link with a set that is not equal."""
    return 100 * size >= percent * (size + 1)


#: Fields of a posting, in the order they are packed in.
POSTING = (("key", "int32"), ("cid", "int64"), ("size", "int32"), ("rest", "int32"), ("bits", "uint64"))
POSTING_BYTES = 28


def _postings(percent: int, parts: int):
    """Postings, one per prefix word with how many words are left from it on, its own included. Those that go to the same part are packed into one row,
    so that Spark moves and sorts few rows."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            prefix = batch.column("prefix")
            offsets = np.frombuffer(prefix.buffers()[1], dtype="int32")[prefix.offset:prefix.offset + len(prefix) + 1]
            counts = np.diff(offsets) // 4
            if not counts.sum():
                continue
            key = np.frombuffer(np.frombuffer(prefix.buffers()[2], dtype="uint8")[offsets[0]:offsets[-1]].tobytes(), dtype="int32")
            place = np.arange(len(key)) - np.repeat(np.cumsum(counts) - counts, counts)
            size = np.repeat(sizes, counts)
            left_out = np.repeat(_prefix(sizes, percent) - counts, counts)
            cid, bits = (np.repeat(c, counts) for c in (batch.column("cid").to_numpy(), Tables(batch.column("sketch")).small(sizes > SKETCHED)))
            held.append([x.astype(kind) for x, (_, kind) in zip((key, cid, size, size - place - left_out, bits), POSTING)])
            n += len(key)
            if n >= PACKED:
                yield _packed(held, parts)
                held, n = [], 0
        if held:
            yield _packed(held, parts)
    return build


def _packed(held: list[list[np.ndarray]], parts: int) -> pa.RecordBatch:
    """One row per part; the bytes of its postings lie by significance, as most high ones are zero."""
    fields = [np.concatenate(f) for f in zip(*held)]
    part = (mix(fields[0].view("uint32").astype("uint64")) % np.uint64(parts)).astype("int32")
    order = np.lexsort([fields[0], part])
    fields, part = [f[order] for f in fields], part[order]
    begins = starts([part])
    chunks = [b"".join(f[s:e].view("uint8").reshape(e - s, -1).T.tobytes() for f in fields) for s, e in zip(begins, np.append(begins[1:], len(part)))]
    return pa.RecordBatch.from_arrays([pa.array(part[begins]), pa.array(chunks, pa.binary())], names=["part", "chunk"])


def _unpacked(chunks: list[bytes]) -> list[np.ndarray]:
    """The fields of packed postings, sorted by key and size."""
    fields: list[list[np.ndarray]] = [[] for _ in POSTING]
    for chunk in chunks:
        raw, at = np.frombuffer(chunk, dtype="uint8"), 0
        n = len(raw) // POSTING_BYTES
        for found, (_, kind) in zip(fields, POSTING):
            width = np.dtype(kind).itemsize
            found.append(np.ascontiguousarray(raw[at:at + n * width].reshape(width, n).T).view(kind).ravel())
            at += n * width
    columns = [np.concatenate(f) for f in fields]
    order = np.lexsort([columns[2], columns[0]])
    return [c[order] for c in columns]


def _list_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Postings of whole parts, from chunks sorted by part. A part has whole keys."""
    held, last, size = [], None, 0
    for batch in batches:
        for part, chunk in zip(batch.column("part").to_pylist(), batch.column("chunk").to_pylist()):
            if part != last and size >= UNPACKED * POSTING_BYTES:
                yield _unpacked(held)
                held, size = [], 0
            held.append(chunk)
            last, size = part, size + len(chunk)
    if held:
        yield _unpacked(held)


def _may_link(lists: np.ndarray, size: np.ndarray, rest: np.ndarray, bits: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list that can still link, each pair once: sizes are near enough, and neither what is left of the words at the first common one
    nor the bits that only one set has rule out enough common words. Rows are sorted by list and size, so a row's partners follow it; they are
    looked at in steps, whatever the length of a list."""
    at = lists.astype("int64") << 32
    partners = np.searchsorted(at + size, at + np.minimum(100 * size.astype("int64") // percent, 0xFFFFFFFF), side="right") - np.arange(len(size)) - 1
    ends = np.cumsum(partners)
    for t in range(0, int(ends[-1]), PAIR_STEP):
        to = min(t + PAIR_STEP, int(ends[-1]))
        rows = np.arange(np.searchsorted(ends, t, side="right"), np.searchsorted(ends, to - 1, side="right") + 1)
        begins = ends[rows] - partners[rows]
        n = np.minimum(ends[rows], to) - np.maximum(begins, t)
        i = np.repeat(rows, n)
        j = i + 1 + np.arange(t, to) - np.repeat(begins, n)
        both = size[i].astype("int64") + size[j]
        near = (100 + percent) * np.minimum(rest[i], rest[j]).astype("int64") >= percent * both
        i, j, both = i[near], j[near], both[near]
        alike = (size[i] > SKETCHED) == (size[j] > SKETCHED)  # bits of the same words
        only_i, only_j = (np.where(alike, np.bitwise_count(bits[x] & ~bits[y]), 0).astype("int64") for x, y in ((i, j), (j, i)))
        near = (100 + percent) * np.minimum(size[i] - only_i, size[j] - only_j) >= percent * both
        yield i[near], j[near]


def _first_pairs(percent: int):
    """From packed lists: each line with the earliest one of the list that it may link with (kind 1), and the list's rows of all other pairs that may
    link (kind 0)."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cid, size, rest, bits in _list_parts(batches):
            earliest, where, some = np.full(len(key), NEVER), np.zeros(len(key), dtype="int64"), np.zeros(len(key), dtype=bool)
            for i, j in _may_link(_numbers([key]), size, rest, bits, percent):
                other = cid[i] != cid[j]
                i, j = i[other], j[other]
                after, before = np.where(cid[i] > cid[j], i, j), np.where(cid[i] > cid[j], j, i)
                known = earliest.copy()
                np.minimum.at(earliest, after, cid[before])
                passed = np.flatnonzero((earliest < known) & (known < NEVER))  # their earliest so far is one of the others now
                some[passed] = some[where[passed]] = True
                best = cid[before] == earliest[after]
                where[after[best]] = before[best]
                some[after[~best]] = some[before[~best]] = True
            later = np.flatnonzero(earliest < NEVER)
            pairs = np.unique(np.stack([cid[later], earliest[later]], axis=1), axis=0)
            kept = np.flatnonzero(some)
            zeros = np.zeros(len(pairs), "int32")
            yield pa.RecordBatch.from_pydict({
                "kind": np.concatenate([np.zeros(len(kept), "int32"), zeros + 1]), "key": np.concatenate([key[kept], zeros]), "cid": np.concatenate([cid[kept], pairs[:, 0]]),
                "earlier": np.concatenate([np.full(len(kept), -1), pairs[:, 1]]), "size": np.concatenate([size[kept], zeros]), "rest": np.concatenate([rest[kept], zeros])})
    return build


def _numbers(keys: list[np.ndarray]) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    begins = starts(keys)
    return np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(keys[0]))))


def _whole_keys(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of whole keys (the named columns), from rows sorted by them. Holds the longest list of a key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in names]
        cut = int(starts(keys)[-1])
        if held and (cut or any(held[-1].column(n)[-1].as_py() != k[0] for n, k in zip(names, keys))):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _other_pairs(percent: int):
    """Lines that are not removed yet with every earlier one of the list that they may link with, by size, place and bit tables. Rows carry the blocks (left,
    right) they are compared for."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, ["key", "left", "right"]):
            key, left, right, cid, size, rest, own, open_ = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "left", "right", "cid", "size", "rest", "own", "open"))
            tables = Tables(batch.column("sketch"))
            bits = tables.small(size > SKETCHED)
            out = []
            for i, j in _may_link(_numbers([key, left, right]), size, rest, bits, percent):
                later, earlier = np.where(cid[i] > cid[j], i, j), np.where(cid[i] > cid[j], j, i)
                wanted = open_[later] & (cid[i] != cid[j]) & ((left[i] == right[i]) | (own[i] != own[j]))
                later, earlier = later[wanted], earlier[wanted]
                near = (100 + percent) * room(tables, later, size[later], tables, earlier, size[earlier]) >= percent * (size[later].astype("int64") + size[earlier])
                out.append(np.stack([cid[later[near]], cid[earlier[near]]], axis=1))
            if out:
                pairs = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_pydict({"cid": pairs[:, 0], "earlier": pairs[:, 1]})
    return build


def _word_sets(table, bits: int, marks, places):
    """The word sets of lines that the filters may hold, of texts and of lines in them."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(table.value, dtype="uint8")
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(marks, batch.column("mark").to_numpy())))
            mark = batch.column("mark").to_numpy()
            for text, line, first, words in _line_sets(batch.column("text"), classes, bits):
                found = _binary(words, np.diff(np.append(first, len(words))))
                rows = pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(text)) for c in ("doc_id", "mark")], pa.array(line), found], names=["doc_id", "mark", "line", "words"])
                yield rows.filter(pa.array(may_hold(places, combined(mark[text], line))))
    return build


def _links(percent: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Jaccard, exact."""
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(x, dtype="uint64"), np.frombuffer(y, dtype="uint64")
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("earlier"), pa.array(ok, pa.bool_())], names=["cid", "earlier", "linked"])
    return build


def _plausible(percent: int):
    """Pairs whose bit tables leave room for enough common words."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
            rows = np.arange(len(size_a))
            most = room(Tables(batch.column("sketch_a")), rows, size_a, Tables(batch.column("sketch_b")), rows, size_b)
            yield batch.select(["cid", "earlier"]).filter(pa.array((100 + percent) * most >= percent * (size_a + size_b)))
    return keep


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    small = classes.select("cid", "size", "sketch")
    known = pairs.join(small.toDF("cid", "size_a", "sketch_a"), "cid").join(small.toDF("earlier", "size_b", "sketch_b"), "earlier")
    return staged(known.mapInArrow(_plausible(percent), "cid long, earlier long"), "plausible")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, table, percent: int, bits: int) -> DataFrame:
    """Linked pairs: the words of the lines themselves are compared. `pairs` is a written table."""
    ids = pairs.select("cid").union(pairs.select("earlier")).distinct()
    needed = staged(classes.select("cid", "doc_id", "mark", "line").join(ids, "cid"), "needed")
    marks, places = key_filter(needed.select("mark")), key_filter(needed.select("mark", "line"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(_word_sets(table, bits, marks, places), f"doc_id {kind}, mark long, line long, words binary")
    sets = staged(same_keys_join(found, needed, ["doc_id", "mark", "line"]).select("cid", "words").dropDuplicates(["cid"]), "words")
    both = pairs.join(sets.withColumnRenamed("words", "a"), "cid").join(sets.select(F.col("cid").alias("earlier"), F.col("words").alias("b")), "earlier")
    return both.mapInArrow(_links(percent), "cid long, earlier long, linked boolean").where("linked").drop("linked")


def later_matches(docs: DataFrame, percent: int = PERCENT, bits: int = BITS, block: int = LIST_BLOCK) -> DataFrame:
    """(doc_id, mark, line) of every line that an earlier one matches; mark is xxhash64 of the text, lines count from 0.

    Time is (doc_id, mark, line), a NULL doc_id last. Lines match when the Jaccard index of their sets of words (lower-cased in A-Z)
    is at least `percent` hundredths; lines without words match none. Equal sets are one class, known by its earliest line. Words
    are ordered by frequency over all texts; a class is listed under the rarest words of its prefix, and size and position thin
    the pairs of a list. Each class is first verified against the earliest candidate of each list. Those that are not removed by that are
    verified against all other earlier candidates, so nothing is missed, and a large group of near copies is not paired in full.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(word_classes(docs.select("text"), bits))
    kind = docs.schema["doc_id"].dataType.simpleString()
    slots = partitions(spark)
    lines = docs.mapInArrow(_lines(table, percent, bits), f"doc_id {kind}, mark long, line long, d1 long, d2 long, size long, prefix binary, sketch binary")
    lines = lines.repartition(slots, "d1").sortWithinPartitions("d1").mapInArrow(_classes, f"doc_id {kind}, mark long, line long, size long, prefix binary, sketch binary")
    lines = staged(lines, "lines", **HASHES)
    # Sorted by time, so that ids grow with it.
    classes = sorted_blocks(lines.where("size > 0").withColumn("none", F.col("doc_id").isNull()), ["none", "doc_id", "mark", "line"])
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()).drop("none"), "classes", **HASHES)
    shape = "part int, chunk binary"
    postings = classes.select("cid", "size", "prefix", "sketch").mapInArrow(_postings(percent, LIST_PARTS), shape)
    postings = postings.repartition(slots, "part").sortWithinPartitions("part")
    found = staged(postings.mapInArrow(_first_pairs(percent), "kind int, key int, cid long, earlier long, size int, rest int"), "lists", **HASHES)
    first = staged(found.where("kind = 1").select("cid", "earlier").distinct(), "pairs")
    gone = staged(_verified(_near(first, classes, percent), docs, classes, table, percent, bits).select("cid").distinct(), "gone")

    lists = found.where("kind = 0").select("key", "cid", "size", "rest").join(gone.withColumn("gone", F.lit(True)), "cid", "left").withColumn("open", F.col("gone").isNull()).drop("gone")
    counts = lists.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("open").alias("any")).where("any")
    blocks = F.ceil(F.col("rows") / block).cast("int")
    lists = lists.join(counts.select("key", "rows"), "key").join(classes.select("cid", "sketch"), "cid").withColumn("own", F.pmod(F.xxhash64("cid"), blocks).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other"))
    lists = lists.repartition(slots, "key", "left", "right").sortWithinPartitions("key", "left", "right", "size").select("key", "left", "right", "cid", "size", "rest", "sketch", "own", "open")
    rest = lists.mapInArrow(_other_pairs(percent), "cid long, earlier long").distinct()
    rest = staged(rest.join(first, ["cid", "earlier"], "left_anti"), "rest")
    more = _verified(rest, docs, classes, table, percent, bits).select("cid")
    gone = staged(gone.unionByName(more).distinct(), "gone")
    place = ["doc_id", "mark", "line"]
    return lines.where("size = 0").select(*place).unionByName(classes.select("cid", *place).join(gone, "cid").select(*place))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, all_lines, removed = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            parts = text.split("\n") if text is not None else []
            drop = set(gone or ())
            texts.append("\n".join(p for i, p in enumerate(parts) if i not in drop) if drop else text)
            all_lines.append(len(parts))
            removed.append(len(drop))
        names = [n for n in batch.schema.names if n != "gone"]
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(all_lines, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_lines", "n_removed"])


def dedup_lines(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), percent: int = PERCENT, bits: int = BITS, block: int = LIST_BLOCK) -> DataFrame:
    """The given columns of every document, its text without the lines that an earlier line matches (later_matches), and
    n_lines, n_removed.

    All documents stay, also those that lose every line; their text is then empty. NULL text stays NULL with 0 lines; an empty text has one
    line. Lines without words stay. Rows repeated in full keep the same lines, those that one of them would keep; other columns of
    the table do not matter. An empty table gives none. Documents that may lose a line are told from the others by a bit table before the shuffle.
    """
    docs = pick(docs, *columns).withColumn("mark", F.xxhash64("text"))
    gone = later_matches(docs.select("doc_id", "mark", "text"), percent, bits, block)
    gone = staged(gone.groupBy("doc_id", "mark").agg(F.collect_set("line").alias("gone")), "removed")
    hit = key_filter(gone.select("mark"))
    shape = docs.drop("mark").schema.add("n_lines", "long").add("n_removed", "long")
    some = same_keys_join(filtered(docs, "mark", hit), gone.hint("shuffle_hash"), ["doc_id", "mark"], "left")  # no sort of the texts
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    others = filtered(docs, "mark", hit, hold=False).select(*columns, F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return some.select(*columns, "gone").mapInArrow(_without, shape).unionByName(others)
