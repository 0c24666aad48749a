"""Keeping one document of each group of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buslens.llm.common import filtered, key_filter, same_keys_join, staged
from buslens.llm.ngram_join import ngram_groups


def keep_one(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of `docs` (doc_id, text and others), one for each group of texts that links of the exact n-gram Jaccard join connect: that
    with the smallest doc_id (NULL last), of equal ids that with the smallest text hash; of rows that repeat both, one.

    Documents without words are in no group and all stay. Only rows that may go, told by a bit table, are shuffled with their text.
    """
    names = docs.columns
    docs = docs.withColumn("mark", F.xxhash64("text"))
    groups = ngram_groups(docs, n, percent).where("n_shingles > 0")
    rows = groups.groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    touched = rows.join(first, "component").select("doc_id", "mark", is_first.alias("stays"), "rows").where("NOT stays OR rows > 1")
    touched = staged(touched.select("doc_id", "mark", "stays"), "touched")
    hit = key_filter(touched.select("mark"))
    found = same_keys_join(filtered(docs, "mark", hit), touched, ["doc_id", "mark"], "left")
    once = found.where("stays").dropDuplicates(["doc_id", "mark"])
    return filtered(docs, "mark", hit, hold=False).select(*names).unionByName(found.where("stays IS NULL").select(*names)).unionByName(once.select(*names))
