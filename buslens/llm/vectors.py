"""Vectors in blocks: bounded matrices that are compared block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from buslens.llm.common import partitions

BLOCK_SCHEMA = "dim int, ids binary, matrix binary"


def usable(vector: str) -> Column:
    """Neither NULL nor holding a NULL, NaN or infinite component."""
    v = F.col(vector)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def pack(pdf: pd.DataFrame) -> Iterator[dict]:
    """One block for each length of vector."""
    for dim, part in pdf.groupby(pdf["vector"].map(len), sort=True):
        matrix = np.array(part["vector"].tolist(), dtype="float64").reshape(len(part), dim)
        yield {"dim": int(dim), "ids": part["id"].to_numpy("int64").tobytes(), "matrix": matrix.tobytes()}


def unpack(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, dtype="int64")
    return ids, np.frombuffer(row.matrix, dtype="float64").reshape(len(ids), row.dim)


def blocks(df: DataFrame, rows: int, n_rows: int) -> DataFrame:
    """One row per block of at most `rows` vectors. df: (id long, vector array<double>) of `n_rows` rows, dealt into blocks by a hash
    of the id; a block that gets too many is cut."""
    n = max(1, -(-n_rows // rows))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for pdf in batches:
            held = pd.concat([held, pdf], ignore_index=True)
            while len(held):
                size = int((held["block"] == held["block"].iloc[0]).sum())
                if size == len(held) and size < rows:
                    break  # the block may go on in the next batch
                size = min(size, rows)
                yield pd.DataFrame(list(pack(held.iloc[:size])))
                held = held.iloc[size:].reset_index(drop=True)
        if len(held):
            yield pd.DataFrame(list(pack(held)))

    dealt = df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    return dealt.repartition(n, "block").sortWithinPartitions("block", "id").mapInPandas(build, BLOCK_SCHEMA)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Gapless numbers from 0 for the few rows of a written table of blocks: only (dim, a hash of the ids) is ordered."""
    keys = df.select("dim", F.xxhash64("ids", "matrix").alias("mark"))
    order = keys.groupBy("dim", "mark").count().select("dim", "mark", (F.expr("row_number() over (order by dim, mark)") - 1).alias(name))
    return df.withColumn("mark", F.xxhash64("ids", "matrix")).join(order, ["dim", "mark"]).drop("mark")


def grid(row_blocks: DataFrame, query_blocks: DataFrame, n_row_blocks: int) -> DataFrame:
    """Every block of queries with every block of rows: the queries are copied once per block of rows, then joined on its number."""
    q = query_blocks.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"),
                            *[c for c in query_blocks.columns if c not in ("dim", "ids", "matrix")],
                            F.explode(F.sequence(F.lit(0), F.lit(max(0, n_row_blocks - 1)))).alias("row_block"))
    n = max(partitions(row_blocks.sparkSession), 1)
    return row_blocks.join(q.repartition(n, "row_block"), "row_block").where("dim = q_dim")
