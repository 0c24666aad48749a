"""Exact Jaccard join of documents on word n-grams, by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buslens.llm.common import filtered, key_filter, partitions, pick, same_keys_join, staged
from buslens.llm.components import components
from buslens.llm.prefix_lists import earliest_partners, most_common, runs, set_sketch, starts
from buslens.llm.words import grams, hash_words, steps

#: Counters of n-gram frequency; a fixed size at any input (4 MB of classes are sent to the tasks).
BITS = 22
#: Counters travel in so many pieces.
PIECES = 64
#: Pieces of the global n-gram order.
FRAGMENTS = 4
#: Documents of one n-gram that are compared with each other in memory; longer lists are compared block against block.
LIST_BLOCK = 2_048


@dataclass(frozen=True)
class Rule:
    """Sets of n-grams link when 100 * intersection >= percent * union."""
    n: int
    percent: int

    def links(self, both, a, b):
        return 100 * both >= self.percent * (a + b - both)

    def prefix(self, size: int) -> int:
        """Two sets that link share one of so many first n-grams of each, in any common order."""
        return size - (self.percent * size + 99) // 100 + 1

    def may_link(self, size_a, rest_a, size_b, rest_b):
        """At their first common n-gram, from which on so many are left, the sets can still link: sizes and overlap suffice."""
        most = np.minimum(rest_a, rest_b).astype("int64")
        fits = 100 * np.minimum(size_a, size_b) >= self.percent * np.maximum(size_a, size_b)
        return fits & ((100 + self.percent) * most >= self.percent * (size_a + size_b))


def _bucket(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype("int64")


def _text_grams(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text, sorted by hash."""
    for _, _, data, cuts in steps(column):
        words, _, at = hash_words(data, cuts)
        for begin, end in zip(at[:-1], at[1:]):
            yield np.unique(grams(words, begin, end, n))


def gram_classes(texts: DataFrame, n: int, bits: int = BITS) -> bytes:
    """A class of frequency (0 to 63) for each of 2**bits n-gram buckets, over all texts.

    Buckets that hold no more than chance would give them are of class 0; beyond that, classes grow with the logarithm. The table
    only orders n-grams, common ones last; which documents link does not depend on it.
    """
    size, piece = 1 << bits, (1 << bits) // PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype="uint32")
        for batch in batches:
            for _, _, data, cuts in steps(batch.column(0)):
                words, _, at = hash_words(data, cuts)
                if len(words) >= n:
                    found = grams(words, 0, len(words), n)
                    inside = np.ones(len(found), dtype=bool)
                    for end in at[1:-1]:
                        inside[max(0, end - n + 1):end] = False
                    np.add.at(total, _bucket(found[inside], bits), np.uint32(1))
        rows = total.reshape(PIECES, piece)
        used = [i for i in range(PIECES) if rows[i].any()]
        small = [rows[i].astype("uint8") if rows[i].max() < 256 else rows[i] for i in used]
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in small], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p not in sums:
                    sums[p] = np.zeros(piece, dtype="int64")
                raw = zlib.decompress(raw)
                sums[p] += np.frombuffer(raw, dtype="uint8" if len(raw) == piece else "uint32")
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary()),
                                          "total": pa.array([int(x.sum()) for x in sums.values()], pa.int64())})

    counted = texts.mapInArrow(count, "piece int, counts binary").repartition(PIECES, "piece").mapInArrow(add, "piece int, counts binary, total long")
    counted = staged(counted, "counts")
    mean = (counted.agg(F.sum("total")).first()[0] or 0) / size

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw in batch.column("counts").to_pylist():
                beyond = (np.frombuffer(raw, dtype="int64") - mean) / np.sqrt(mean + 1)
                out.append(np.where(beyond < 4, 0, np.clip(np.floor(2 * np.log2(np.maximum(beyond, 4) / 4)) + 1, 1, 63)).astype("uint8").tobytes())
            yield pa.RecordBatch.from_pydict({"piece": batch.column("piece"), "classes": pa.array(out, pa.binary())})

    table = bytearray(size)
    for row in counted.mapInArrow(classes, "piece int, classes binary").collect():  # 2**bits bytes in all
        table[row.piece * piece:(row.piece + 1) * piece] = row.classes
    return bytes(table)


def _ordered(found: np.ndarray, classes: np.ndarray, bits: int) -> np.ndarray:
    """Keys of n-grams in the global order: class first, then hash."""
    return np.sort((classes[_bucket(found, bits)].astype("uint64") << np.uint64(58)) | (found >> np.uint64(6)))


def _fragment(keys: np.ndarray, fragments: int) -> np.ndarray:
    """Places where a sorted set is cut: hashes spread evenly, so class 0 is cut evenly, and all higher classes are the last piece."""
    cuts = np.array([(1 << 58) * i // (fragments - 1) for i in range(1, fragments)], dtype="uint64")
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


def document_sets(docs: DataFrame, rule: Rule, table, bits: int = BITS) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, digest of the whole set, its prefix and its sketch. One row per document."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(table.value, dtype="uint8")
        for batch in batches:
            sizes, digests, prefixes, sketches = [], [], [], []
            for found in _text_grams(batch.column("text"), rule.n):
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                prefixes.append(_ordered(found, classes, bits)[:rule.prefix(len(found))].tobytes() if len(found) else None)
                sketches.append(set_sketch(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (digests, prefixes, sketches)]],
                                             names=["doc_id", "mark", "n_shingles", "digest", "prefix", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(build, f"doc_id {kind}, mark long, n_shingles long, digest binary, prefix binary, sketch binary")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per n-gram of a prefix: how many n-grams are left from it on, its own included."""
    for batch in batches:
        sizes = batch.column("n_shingles").to_numpy()
        keys = [np.frombuffer(x, dtype="int64") for x in batch.column("prefix").to_pylist()]
        if not keys:
            continue
        counts = np.array([len(k) for k in keys])
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        size = np.repeat(sizes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(batch.column("cid").to_numpy(), counts)), pa.array(size.astype("int32")), pa.array((size - place).astype("int32"))],
                                         names=["key", "cid", "size", "rest"])


def _stars(rule: Rule):
    """Of rows sorted by key, and then with the largest share left first: each row paired with the first one of its list that it
    may link with (kind 1), and the list's rows that may link with any (kind 0)."""
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cid, size, rest in runs(batches, ["key", "cid", "size", "rest"], 1):
            begins = starts([key])
            counts = np.diff(np.append(begins, len(key)))
            def may_link(x, y, size=size.astype("int64"), rest=rest):
                return rule.may_link(size[x], rest[x], size[y], rest[y])

            earliest, some = earliest_partners(begins, counts, may_link, kinds=size.astype("int64") << 32 | rest, kinds_may_link=may_link)
            other = np.flatnonzero(earliest >= 0)
            a, b = cid[earliest[other]], cid[other]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            kept = np.flatnonzero(some)
            zeros, n = np.zeros(len(pairs), "int32"), len(kept)
            yield pa.RecordBatch.from_pydict({
                "kind": np.concatenate([np.zeros(n, "int32"), zeros + 1]), "key": np.concatenate([key[kept], pairs[:, 0]]), "cid": np.concatenate([cid[kept], pairs[:, 1]]),
                "size": np.concatenate([size[kept], zeros]), "rest": np.concatenate([rest[kept], zeros])})
    return stars


def _cross_pairs(rule: Rule, block: int):
    """Pairs of one list that lie in different components and may link. Rows carry the blocks (left, right) they are compared for."""
    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, left, right, cid, size, rest, comp, own in runs(batches, ["key", "left", "right", "cid", "size", "rest", "comp", "own"], 3):
            out = []
            begins = starts([key, left, right])
            for s, e in zip(begins, np.append(begins[1:], len(key))):
                if (comp[s:e] == comp[s]).all():
                    continue
                x, y = np.arange(s, e)[own[s:e] == left[s]], np.arange(s, e)[own[s:e] == right[s]]
                for i in range(0, len(x), 256):
                    some = x[i:i + 256, None]
                    ok = (comp[some] != comp[y]) & rule.may_link(size[some].astype("int64"), rest[some], size[y].astype("int64"), rest[y])
                    p, q = np.nonzero(ok & (cid[some] < cid[y]) if left[s] == right[s] else ok)
                    out.append(np.stack([cid[x[i:i + 256][p]], cid[y[q]]], axis=1))
            if out:
                pairs = np.concatenate(out)
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                yield pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]})
    return cross


def _segments(rule: Rule, table, bits: int, fragments: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = np.frombuffer(table.value, dtype="uint8")
        for batch in batches:
            cids, numbers, keys = [], [], []
            for cid, found in zip(batch.column("cid").to_pylist(), _text_grams(batch.column("text"), rule.n)):
                ordered = _ordered(found, classes, bits)
                at = _fragment(ordered, fragments)
                for f in range(fragments):
                    if at[f + 1] > at[f]:
                        cids.append(cid)
                        numbers.append(f)
                        keys.append(ordered[at[f]:at[f + 1]].tobytes())
            yield pa.RecordBatch.from_pydict({"cid": pa.array(cids, pa.int64()), "fragment": pa.array(numbers, pa.int32()), "keys": pa.array(keys, pa.binary())})
    return cut


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Common n-grams of a pair within one fragment."""
    for batch in batches:
        both = []
        for x, y in zip(batch.column("keys_a").to_pylist(), batch.column("keys_b").to_pylist()):
            x, y = np.frombuffer(x, dtype="uint64"), np.frombuffer(y, dtype="uint64")
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            both.append(int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("fragment"), pa.array(both, pa.int64())], names=["a", "b", "fragment", "overlap"])


def _plausible(rule: Rule):
    """Pairs whose sketches leave room for enough common n-grams."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*[batch.column(c).to_pylist() for c in ("sketch_a", "size_a", "sketch_b", "size_b")])
            ok = [bool(rule.links(most_common(x, m, y, n), m, n)) for x, m, y, n in columns]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return keep


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule, table, bits: int, fragments: int) -> DataFrame:
    """The linked pairs (a, b). Sketches rule out most others; then common n-grams are counted per fragment, and summed."""
    small = classes.select("cid", "size", "sketch")
    known = pairs.join(small.toDF("a", "size_a", "sketch_a"), "a").join(small.toDF("b", "size_b", "sketch_b"), "b")
    pairs = staged(known.mapInArrow(_plausible(rule), "a long, b long"), "plausible")
    needed = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b"))).distinct().join(classes.select("cid", "doc_id", "mark", "size"), "cid")
    needed = staged(needed, "needed")
    docs = filtered(docs, "mark", key_filter(needed.select("mark")))
    # Shuffled, whatever the size: two Python steps in one task would hold two workers, and each executor keeps them from then on.
    texts = same_keys_join(docs, needed.select("cid", "doc_id", "mark").hint("merge"), ["doc_id", "mark"]).select("cid", "text")
    segments = staged(texts.mapInArrow(_segments(rule, table, bits, fragments), "cid long, fragment int, keys binary"), "segments")
    left = pairs.join(segments.select(F.col("cid").alias("a"), "fragment", F.col("keys").alias("keys_a")), "a")
    both = left.join(segments.select(F.col("cid").alias("b"), "fragment", F.col("keys").alias("keys_b")), ["b", "fragment"])
    partial = both.select("a", "b", "fragment", "keys_a", "keys_b").mapInArrow(_overlaps, "a long, b long, fragment int, overlap long")
    # A row that the table holds twice gives a class's segments twice: the same overlap counts once.
    sums = partial.groupBy("a", "b", "fragment").agg(F.max("overlap").alias("overlap")).groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    sizes = needed.select("cid", "size").distinct()
    sums = pairs.join(sums, ["a", "b"], "left").join(sizes.withColumnsRenamed({"cid": "a", "size": "size_a"}), "a").join(sizes.withColumnsRenamed({"cid": "b", "size": "size_b"}), "b")
    both = F.coalesce("overlap", F.lit(0))
    return sums.where(rule.links(both, F.col("size_a"), F.col("size_b"))).select("a", "b")


def ngram_components(docs: DataFrame, n: int = 4, percent: int = 85, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: see ngram_groups."""
    return ngram_groups(docs, n, percent, **options).select("doc_id", "n_shingles", "component_id")


def ngram_groups(docs: DataFrame, n: int = 4, percent: int = 85, bits: int = BITS, fragments: int = FRAGMENTS, block: int = LIST_BLOCK) -> DataFrame:
    """doc_id, mark (xxhash64 of the text), n_shingles, component_id and component (a number of its own) of every document, from the
    exact Jaccard join.

    N-grams are put in one global order, common ones last (gram_classes). Documents with equal sets form a class. In the order, two
    linked sets share an n-gram of their short prefixes: lists of classes by prefix n-gram give candidates, thinned by size and
    position. The order is cut into fragments; each candidate pair's overlap is counted per fragment and summed.

    No list is expanded into all pairs: first each class is paired with one of each list, by share of n-grams left; the links
    found give components. Then only pairs of different components that still may link are verified, so no link between
    components is lost, and pairs within one need no proof.

    Words are lower-cased in A-Z only. A text of fewer than n words is one n-gram. NULL, empty and wordless texts have 0 and
    their own id; a NULL doc_id counts as larger than any, so a component of NULL ids alone has NULL. Repeated rows are one class
    and give a row each. An empty table gives none.
    """
    rule = Rule(n, percent)
    docs = pick(docs, "doc_id", "text").withColumn("mark", F.xxhash64("text"))
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(gram_classes(docs.select("text"), n, bits))
    sets = staged(document_sets(docs, rule, table, bits), "sets")
    groups = sets.where("n_shingles > 0").groupBy("digest", "n_shingles").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("r"), F.max("prefix").alias("prefix"), F.max("sketch").alias("sketch"))
    classes = staged(groups.select(F.monotonically_increasing_id().alias("cid"), "digest", "n_shingles", F.col("n_shingles").cast("int").alias("size"), "r.doc_id", "r.mark", "prefix", "sketch"), "classes")
    slots = partitions(spark)
    postings = classes.select("cid", "n_shingles", "prefix").mapInArrow(_postings, "key long, cid long, size int, rest int")
    postings = postings.repartition(slots, "key").sortWithinPartitions("key", (-F.col("rest") / F.col("size")), "cid")
    found = staged(postings.mapInArrow(_stars(rule), "kind int, key long, cid long, size int, rest int"), "lists")
    lists = found.where("kind = 0").drop("kind")
    first = staged(found.where("kind = 1").select(F.col("key").alias("a"), F.col("cid").alias("b")).distinct(), "pairs")
    comp = staged(components(staged(_verified(first, docs, classes, rule, table, bits, fragments), "links")), "components")

    placed = lists.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    spans = placed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    placed = placed.join(spans.select("key", "rows"), "key")
    blocks = F.ceil(F.col("rows") / block).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumn("left", F.least("own", "other")).withColumn("right", F.greatest("own", "other"))
    placed = placed.repartition(slots, "key", "left", "right").sortWithinPartitions("key", "left", "right", "cid")
    rest = placed.select("key", "cid", "size", "rest", "comp", "own", "left", "right").mapInArrow(_cross_pairs(rule, block), "a long, b long").distinct()
    rest = staged(rest.join(first, ["a", "b"], "left_anti"), "rest")
    more = staged(_verified(rest, docs, classes, rule, table, bits, fragments), "more")
    if not more.isEmpty():
        comp = staged(components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")

    named = classes.select("cid", "digest", "n_shingles", "doc_id").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = staged(named.join(smallest, "component").select("digest", "n_shingles", "component", "component_id"), "named")
    linked = sets.select("doc_id", "mark", "n_shingles", "digest").join(named, ["digest", "n_shingles"], "left")
    return linked.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")
