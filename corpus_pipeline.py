"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from buslens.llm.common import pick, staged, table
from buslens.llm.language import UNKNOWN, identify
from buslens.llm.line_dedup import dedup_lines
from buslens.llm.mixing import mixed_documents
from buslens.llm.near_duplicates import keep_one
from buslens.llm.packing import pack

#: Columns of documents.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose words are, in the mean, of no language with this probability go. Documents in several languages stay.
MIN_SURE = 0.5
#: Near duplicates: shingles of so many words, and hundredths of Jaccard similarity.
SHINGLE, PERCENT = 5, 80
#: What goes to a Python worker at once, in rows and bytes: documents are whole texts, and the batches of all tasks lie in the executor beside its heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are each of a language, be it one or several. NULL and empty texts and texts without a letter go.

    Sets the session's batch size for Python workers, for this stage and those that follow it.
    """
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    named = identify(pick(docs, *COLUMNS), keep=COLUMNS, sureness=True)
    return named.where((F.col("lang_pred") != UNKNOWN) & (F.col("sure") >= MIN_SURE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier line. All documents stay."""
    return dedup_lines(docs, COLUMNS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return keep_one(pick(docs, *COLUMNS), SHINGLE, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of weighted sources takes them."""
    return mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences."""
    return pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("mix", mix), ("pack", sequences)]

#: SQL has neither the language model nor the tokenizer; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
