"""Main text of web pages by differencing each page with the nearest page of its host."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from buslens.llm.common import pick, same_keys_join, sorted_blocks, staged
from buslens.llm.html_lines import Line, page_lines


#: Cells of a table of lengths, at most.
CELLS = 1 << 22


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which lines of `a` are in a longest common subsequence with `b`. Lines that only one page has are left out first, as no
    common subsequence holds them. Pages are halved until a table of lengths is small (Hirschberg), so memory grows with the lines."""
    in_a, in_b = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
    shared = np.zeros(len(a), dtype=bool)
    _, both = np.unique(np.concatenate([a[in_a], b[in_b]]), return_inverse=True)
    both = both.ravel().astype("int32")
    x, y = both[:len(in_a)], both[len(in_a):]
    parts = [(0, len(x), 0, len(y))]
    while parts:
        i, j, k, m = parts.pop()
        top = _alike_lines(x[i:j], y[k:m])
        shared[in_a[i:i + top]] = True
        i, k = i + top, k + top
        end = _alike_lines(x[i:j][::-1], y[k:m][::-1])
        shared[in_a[j - end:j]] = True
        j, m = j - end, m - end
        if i == j or k == m:
            continue
        if j - i == 1:
            shared[in_a[i]] = bool((y[k:m] == x[i]).any())
        elif (j - i + 1) * (m - k + 1) <= CELLS:
            shared[in_a[i:j][_by_table(x[i:j], y[k:m])]] = True
        else:
            half = (i + j) // 2
            cut = k + int((_lengths(x[i:half], y[k:m]) + _lengths(x[half:j][::-1], y[k:m][::-1])[::-1]).argmax())
            parts += [(i, half, k, cut), (half, j, cut, m)]
    return shared


def _alike_lines(x: np.ndarray, y: np.ndarray) -> int:
    """Lines that two pages begin with alike."""
    n = min(len(x), len(y))
    other = x[:n] != y[:n]
    return int(other.argmax()) if other.any() else n


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of x with each beginning of y, of 0 to all of its lines; one row is held."""
    row = np.zeros(len(y) + 1, dtype="int32")
    for line in x:
        # max(above, diagonal + 1 where equal), then the running maximum from the left
        row[1:] = np.maximum(row[1:], (row[:-1] + 1) * (y == line))
        np.maximum.accumulate(row, out=row)
    return row


def _by_table(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which lines of x are in a longest common subsequence with y, by a table of the lengths of what is left of both."""
    shared = np.zeros(len(x), dtype=bool)
    lengths = np.zeros((len(x) + 1, len(y) + 1), dtype="int32")
    for i in range(len(x) - 1, -1, -1):
        row = lengths[i + 1].copy()
        row[:-1] = np.maximum(row[:-1], np.where(y == x[i], lengths[i + 1][1:] + 1, 0))
        lengths[i] = np.maximum.accumulate(row[::-1])[::-1]
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j] and lengths[i, j] == lengths[i + 1, j + 1] + 1:
            shared[i] = True
            i, j = i + 1, j + 1
        elif lengths[i + 1, j] >= lengths[i, j + 1]:
            i += 1
        else:
            j += 1
    return shared


def _hash(line: Line) -> int:
    return int.from_bytes(hashlib.blake2b(line.text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def wanted(lines: list[Line]) -> list[bool]:
    """Lines that markup does not rule out: none of menus, headers, footers and the like; only the article if the page marks one."""
    any_main = any(line.main and not line.chrome for line in lines)
    return [not line.chrome and (line.main or not any_main) for line in lines]


def _parsed(batches: Iterator[pa.RecordBatch], markup: bool) -> Iterator[pa.RecordBatch]:
    """Each page's lines: hashes of all of them, a digest that copies have in common, and the texts that markup leaves with their places among all lines, or
    -1 for a line that stays even if the neighbour has it."""
    for batch in batches:
        pages = [page_lines(value.as_py() or "") for value in batch.column("html")]
        hashes = [np.array([_hash(line) for line in lines], dtype="int64") for lines in pages]
        copies = [hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in hashes]
        texts, places = [], []
        for lines in pages:
            left = [i for i, ok in enumerate(wanted(lines)) if ok] if markup else range(len(lines))
            texts.append([lines[i].text for i in left])
            places.append([-1 if markup and lines[i].main else i for i in left])
        names = [n for n in batch.schema.names if n != "html"]
        new = [pa.array(hashes, pa.list_(pa.int64())), pa.array(copies, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], names=[*names, "hashes", "copy", "texts", "places"])


_KEYS = ["host", "path", "copy"]
#: Pages with this share of the longer one's lines in common are copies of each other.
COPY = 0.9
#: Places, among the rows of a block, of the four rows around it.
OUTER, BEFORE, AFTER, BEYOND = -2, -1, 2**62, 2**62 + 1


class Row(NamedTuple):
    host: str
    path: str
    hashes: np.ndarray
    copy: bytes


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def nearly_equal(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two pages have at least COPY of the longer one's lines in common, in any order."""
    least = COPY * max(len(a), len(b))
    if min(len(a), len(b)) < least:
        return False
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum()) >= least


def _begins_run(row: Row, before: Row | None) -> bool:
    """Whether a page does not go on the run of copies that the page before it is in."""
    return before is None or before.host != row.host or not nearly_equal(before.hashes, row.hashes)


def _nearest(row: Row, before: Row | None, after: Row | None) -> Row | None:
    """Of two pages, the one of the same host whose path starts alike the longest (ties: the one before)."""
    near = [other for other in (before, after) if other is not None and other.host == row.host]
    return max(near, key=lambda other: _alike(row.path, other.path), default=None)


def _pairs(run: list[Row], outer: Row | None, before: Row | None, after: Row | None, beyond: Row | None) -> Iterator[tuple[Row, Row | None]]:
    """The page that each of a run of copies is compared with. `outer` and `beyond` are the pages around the run, `before` and `after` those next to
    the given rows. Copies have the text in common as well, so the nearest page outside the run is taken, unless it is a copy of the page too.
    Where a run is all of its host nothing tells text from site, and what the pages next to each other share is the site's."""
    for i, row in enumerate(run):
        around = [other for other in (outer, beyond) if other is not None and other.host == row.host]
        if around:
            other = _nearest(row, *[None if o is None or nearly_equal(row.hashes, o.hashes) else o for o in (outer, beyond)])
        else:
            other = _nearest(row, run[i - 1] if i else before, run[i + 1] if i + 1 < len(run) else after)
        yield row, other


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their block and place, and whether a run of copies begins there (NULL for a block's first row)."""
    block, place, last = TaskContext.get().partitionId(), 0, None
    for batch in batches:
        n, begins = batch.num_rows, []
        for row in _rows(batch):
            begins.append(_begins_run(row, last) if last else None)
            last = row
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, block, "int64")), pa.array(np.arange(place, place + n)), pa.array(begins, pa.bool_())],
            names=[*batch.schema.names, "block", "place", "begins"])
        place += n


def _rows(batch: pa.RecordBatch) -> Iterator[Row]:
    hashes = (np.array(h.as_py() or [], dtype="int64") for h in batch.column("hashes"))
    return (Row(*values) for values in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), hashes, batch.column("copy").to_pylist()))


def _first_begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the first row of each block, whether a run begins there, by the last row of the block before it."""
    for batch in batches:
        before = batch.select(["host0", "path0", "hashes0", "copy0"]).rename_columns(["host", "path", "hashes", "copy"])
        begins = [_begins_run(row, None if last.host is None else last) for row, last in zip(_rows(batch), _rows(before))]
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(begins, pa.bool_())], names=["block", "starts"])


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block in URL order, with the rows around it. The rows of one run of copies are held at a time, at most a block."""
    run: list[Row] = []
    around: dict[int, Row] = {}
    outer = before = last = None

    def flush(after: Row | None, beyond: Row | None) -> pa.RecordBatch:
        rows = [(row, common_lines(row.hashes, other.hashes).tolist()) for row, other in _pairs(run, outer, before, after, beyond) if other is not None]
        return _result(rows)

    for batch in batches:
        for row, place, begins in zip(_rows(batch), batch.column("place").to_pylist(), batch.column("begins").to_pylist()):
            if place in (OUTER, BEFORE, AFTER, BEYOND):
                around[place] = row
                continue
            if last is None:
                last = around.get(BEFORE)
                if not _begins_run(row, last):
                    begins, outer, before = False, around.get(OUTER), last
            if begins is not False:
                if run:
                    yield flush(row, row)
                run, outer, before = [], last, last
            run.append(row)
            last = row
    if run:
        yield flush(around.get(AFTER), around.get(BEYOND))


def _result(done: list[tuple[Row, list[bool]]]) -> pa.RecordBatch:
    rows = [(r.host, r.copy, s) for r, s in done if any(s)]
    return pa.RecordBatch.from_pydict({"host": pa.array([r[0] for r in rows], pa.string()), "copy": pa.array([r[1] for r in rows], pa.binary()), "shared": pa.array([r[2] for r in rows], pa.list_(pa.bool_()))})


def parsed_pages(pages: DataFrame, markup: bool) -> DataFrame:
    """Pages with their host and path, and their lines (`_parsed`), in place of their html. Written, so that a page is parsed once."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select("page_id", "url", "mark", host.alias("host"), path.alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    kinds = pages.select("page_id", "url").schema
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return staged(rows.mapInArrow(partial(_parsed, markup=markup), f"{shape}, mark long, host string, path string, hashes array<long>, copy binary, texts array<string>, places array<int>"), "parsed")


def shared_lines(every: DataFrame) -> DataFrame:
    """(page_id, mark, shared), of pages with such lines: for each line of a page, whether the nearest page of its host that is no copy of it
    has it at the same place in a longest common subsequence. Only hashes of lines are shuffled. Pages of a host with the same lines are one
    row, with the smallest path. Rows are range-sorted by host and path, so a large host is spread over many tasks. Neighbours that are nearly
    equal form a run, however long; a run is compared with the pages around it (`_pairs`). Each block also gets four rows of other blocks: those
    next to it, and those around the runs that it begins and ends in. every: parsed_pages."""
    rows = every.groupBy("host", "copy").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes")).select("host", "path", "hashes", "copy")
    shape = "host string, path string, hashes array<long>, copy binary, block long, place long, begins boolean"
    rows = staged(sorted_blocks(rows, _KEYS).mapInArrow(_numbered, shape), "sorted")
    # A block is at most one range of the sort above.
    sides = rows.withColumn("to", F.col("block")).unionByName(_around(rows)).drop("block").repartition("to").sortWithinPartitions("to", "place")
    found = staged(sides.withColumnRenamed("to", "block").mapInArrow(_by_blocks, "host string, copy binary, shared array<boolean>"), "differenced")
    # Equal rows have equal lines.
    own = every.select("page_id", "mark", "host", "copy").distinct()
    return same_keys_join(own, found, ["host", "copy"]).select("page_id", "mark", "shared")


def _around(rows: DataFrame) -> DataFrame:
    """The four rows around each block, as rows of it. Windows run over one small row per block."""
    blocks = rows.groupBy("block").agg(F.max("place").alias("last"), F.min(F.when(F.col("begins"), F.col("place"))).alias("first_run"), F.max(F.when(F.col("begins"), F.col("place"))).alias("last_run"))
    order = Window.orderBy("block")
    side = lambda column, step: F.lag(column, step).over(order)
    blocks = staged(blocks.select("*", side("block", 1).alias("prev"), side("last", 1).alias("prev_last"), side("block", -1).alias("next")), "blocks")
    ends = rows.select(F.col("block").alias("prev"), F.col("place").alias("prev_last"), *[F.col(c).alias(f"{c}0") for c in ("host", "path", "hashes", "copy")])
    ends = ends.join(blocks.select("block", "prev", "prev_last"), ["prev", "prev_last"]).drop("prev", "prev_last")
    starts = rows.where(F.col("place") == 0).drop("place", "begins").join(ends, "block", "left").mapInArrow(_first_begins, "block long, starts boolean")
    blocks = blocks.join(starts, "block").withColumn("first_run", F.when(F.col("starts"), 0).otherwise(F.col("first_run")))
    blocks = blocks.withColumn("last_run", F.coalesce("last_run", F.when(F.col("starts"), 0)))
    # The row before the run that is open when a block begins, and the first row of the next run after the block.
    opened = F.when(F.col("last_run") > 0, F.struct("block", (F.col("last_run") - 1).alias("place"))).when(F.col("last_run") == 0, F.struct(F.col("prev").alias("block"), F.col("prev_last").alias("place")))
    coming = F.when(F.col("first_run").isNotNull(), F.struct("block", F.col("first_run").alias("place")))
    asked = blocks.select(F.col("block").alias("to"), F.array(
        F.struct(F.lit(OUTER).cast("long").alias("at"), F.last(opened, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("row")),
        F.struct(F.lit(BEFORE).cast("long").alias("at"), F.struct(F.col("prev").alias("block"), F.col("prev_last").alias("place")).alias("row")),
        F.struct(F.lit(AFTER).alias("at"), F.struct(F.col("next").alias("block"), F.lit(0).cast("long").alias("place")).alias("row")),
        F.struct(F.lit(BEYOND).alias("at"), F.first(coming, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("row"))).alias("asked"))
    asked = asked.select("to", F.explode("asked").alias("a")).select("to", "a.at", "a.row.block", "a.row.place").where(F.col("block").isNotNull())
    found = rows.join(staged(asked, "asked"), ["block", "place"])
    return found.select("host", "path", "hashes", "copy", "block", F.col("at").alias("place"), F.lit(None).cast("boolean").alias("begins"), "to")


def _by_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_differenced for each block on its own: a partition may hold several."""
    def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            for s, e in zip(begins, [*begins[1:], len(block)]):
                yield int(block[s]), batch.slice(s, e - s)

    waiting: list[tuple[int, pa.RecordBatch]] = []
    source = parts()
    waiting += [p for p in [next(source, None)] if p]
    while waiting:
        own = waiting[0][0]

        def of_block() -> Iterator[pa.RecordBatch]:
            yield waiting.pop()[1]
            for block, batch in source:
                if block != own:
                    waiting.append((block, batch))
                    return
                yield batch

        yield from _differenced(of_block())


def _main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for lines, places, shared in zip(*(batch.column(c).to_pylist() for c in ("texts", "places", "shared"))):
            texts.append("\n\n".join(line for line, place in zip(lines, places) if place < 0 or not shared or not shared[place]))
        names = [n for n in batch.schema.names if n not in ("texts", "places", "shared")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])


def extract(pages: DataFrame, *, markup: bool = True) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars. Blocks in page order, joined by an empty line.

    Pages of a host are put in order of URL path, and each is paired with its neighbour whose path starts alike the longest. Neighbours with COPY
    of their lines in common are copies, which share their text as well: they are paired with the pages around all of them, whatever their
    number, and with each other only if the host has nothing else. The pair's text lines are aligned by a longest common subsequence; lines that
    both have are deleted. Markup has its say as well, unless `markup` is false: lines in menus, headers, footers, sidebars, notices, adverts,
    forms, comments and hidden elements go in any case, and lines in a marked article stay, as copies of an article share all their lines. On
    a page that marks no article, all other lines are left to differencing.

    NULL html counts as empty and gives an empty text; a NULL url is an empty one, and so of host ''. Pages alone in their host, or
    with nothing but pages of the same lines around them, have no pair and lose no line to it. Pages with the same lines count as one page and have
    the same pair. An empty table gives none. A page is parsed once; what it may keep is written with the hashes of its lines.
    """
    pages = pick(pages, "page_id", "url", "html").withColumn("mark", F.xxhash64("url", "html"))
    every = parsed_pages(pages, markup)
    shared = staged(shared_lines(every), "shared")
    found = same_keys_join(every, shared, ["page_id", "mark"], "left")
    shape = T.StructType([*pages.select("page_id", "url").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return found.select("page_id", "url", "texts", "places", "shared").mapInArrow(_main_text, shape)
