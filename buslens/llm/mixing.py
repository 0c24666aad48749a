"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from buslens.llm.common import ASCII_WORD, pick, running_sums, same_keys_join, staged

#: Weights dealt to the sources in code point order, over and over.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all words.
SHARE = 1.5
#: A document goes into the mix this many times at most.
REPEATS = 2
SEED = "mix-1"
#: Words that are served at once: longer documents queue in so many parts as they need.
QUANTUM = 256


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(ASCII_WORD)).cast("long"), F.lit(0).cast("long"))


def shuffle_key(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A fixed pseudo-random order of documents."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per source: source_size and target. sizes: rows of (source, size).

    The sources share `share` of all words by weight; a target stops at `repeats` times its source's size, and the excess is
    shared again by weight. Sorted by size over weight, the stopped sources come first, so running sums give the level at once.
    One row per source passes through the windows.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    level = ", ".join(f"{w}D" for w in weights)
    return sums.sparkSession.sql(f"""
        WITH weighted AS (
          SELECT source, source_size, {repeats}L * source_size AS stop,
                 array({level})[CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} AS INT)] AS weight
          FROM {{sums}}),
        placed AS (
          SELECT *, row_number() OVER (ORDER BY stop / weight, source ASC NULLS LAST) AS place,
                 (SELECT sum(source_size) FROM {{sums}}) * {share}D AS budget FROM weighted),
        levels AS (
          SELECT *, (budget - coalesce(sum(stop) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM placed),
        free AS (SELECT min(place) AS place, min_by(level, place) AS level FROM levels WHERE level * weight <= stop)
        SELECT source, source_size, CASE WHEN place < coalesce((SELECT place FROM free), place + 1) THEN CAST(stop AS DOUBLE)
                                         ELSE (SELECT level FROM free) * weight END AS target
        FROM levels""", sums=sums)


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, key: Column | None = None, quantum: int = QUANTUM) -> DataFrame:
    """Which documents a mix of weighted sources takes, one row per row of `docs`.

    Each source's documents queue in a fixed shuffled order, again and again up to `repeats` times, in parts of at most `quantum` words. A part's virtual finish time
    is the source's words up to its end over the source's target. All parts of all sources are range-sorted by it, and taken until their words reach the
    budget, where the last one is cut. As targets add up to the budget, that is when each source is within a part of its target; no source is cut by itself.

    Columns: doc_id, source, size, source_size, target, taken (words, repeats counted), copies (whole ones), part (words of the
    cut one), and row_key if `key` gives one. NULL text has size 0; a NULL source is a source of its own, last in order; NULL
    doc_id shuffles as the word null. Documents of size 0 are taken once, with 0 words, if their finish time is in the mix. Equal finish times go by source,
    shuffled order and size, so rows repeated in full are interchangeable and get the same rows in any run. Texts of any length are counted whole. Other
    columns are ignored, whatever their names. An empty table gives none.
    """
    docs = docs.withColumn("__key", key if key is not None else F.lit(0).cast("long"))
    rows = pick(docs, "doc_id", "source", "text", "__key").select("doc_id", "source", n_words().alias("size"), shuffle_key(seed=seed).alias("order"), F.col("__key").alias("row_key"))
    rows = staged(rows, "sizes")
    goals = staged(targets(rows, weights, share, repeats), "targets")
    queued = running_sums(rows, ["source", "order", "size", "row_key"], "size", "source")
    queued = same_keys_join(queued, goals, ["source"]).withColumnRenamed("block", "row_block").withColumnRenamed("place", "row_place")
    copies = queued.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("size") > 0, repeats - 1).otherwise(0))).alias("copy"))
    parts = copies.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / quantum) - 1, F.lit(0)))).alias("part"))
    words = F.least(F.lit(quantum).cast("long"), F.col("size") - F.col("part") * quantum)
    end = F.col("copy") * F.col("source_size") + F.col("before") + F.col("part") * quantum + words
    finish = F.when(F.col("target") > 0, end / F.col("target")).otherwise(F.lit(0.0))
    parts = parts.select("row_block", "row_place", "copy", "part", "source", "order", "size", "row_key", "doc_id", "source_size", "target", words.alias("words"), finish.alias("finish"))
    mixed = running_sums(parts, ["finish", "source", "order", "size", "row_block", "row_place", "copy", "part"], "words")
    budget = F.lit(goals.agg(F.floor(F.sum("source_size") * F.lit(share))).first()[0] or 0)
    taken = F.greatest(F.lit(0).cast("long"), F.least(F.col("words"), budget - F.col("before")))
    found = mixed.groupBy("row_block", "row_place").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target", "row_key")],
        F.sum(taken).alias("taken"), F.max((F.col("before") <= budget).cast("long")).alias("reached"))
    # A source serves one copy to its end before the next one begins.
    whole = F.when(F.col("size") > 0, F.expr("taken div greatest(size, 1L)")).otherwise(F.col("reached"))
    return found.select("doc_id", "source", "size", "source_size", "target", "row_key", "taken", whole.alias("copies"), F.expr("taken % greatest(size, 1L)").alias("part"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts up to the end of their word number `part`."""
    word = re.compile(ASCII_WORD)
    for batch in batches:
        texts = []
        for text, part in zip(batch.column("text").to_pylist(), batch.column("part").to_pylist()):
            end = 0
            for k, m in enumerate(word.finditer(text), 1):
                end = m.end()
                if k == part:
                    break
            texts.append(text[:end])
        changed = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
        names = [n for n in batch.schema.names if n != "part"]
        yield pa.RecordBatch.from_arrays([changed.get(n, batch.column(n)) for n in names], names=names)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of doc_id, text, lang, source, n_chars, a document once for each time it is taken.

    A copy that the budget cuts holds the words up to there (one for a source at most). Copies of a row that is repeated in full are counted together. NULL texts
    and sources, ties, empty tables and other columns: as in `fair_mix`.
    """
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = pick(docs, *names)
    key = F.xxhash64(*names)
    plan = fair_mix(docs, key=key, **options).groupBy("doc_id", "row_key").agg(F.sum("copies").alias("copies"), F.max("part").alias("part"), F.count(F.lit(1)).alias("rows"))
    plan = staged(plan.where("copies > 0 or part > 0"), "plan")
    found = same_keys_join(docs.withColumn("row_key", key), plan, ["doc_id", "row_key"])
    single = found.where("rows = 1").unionByName(found.where("rows > 1").dropDuplicates(["doc_id", "row_key"]))
    whole = single.where("copies > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
    cut = single.where("part > 0").select(*names, "part").mapInArrow(_cut, docs.schema)
    return whole.unionByName(cut)
