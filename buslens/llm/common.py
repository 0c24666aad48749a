"""Shared steps: picking input columns, written intermediate tables, running sums over a range-sorted table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from buslens.plans.staging import new_path, same_keys_join, staged

__all__ = ["ASCII_WORD", "combined", "filtered", "key_filter", "may_hold", "new_path", "partitions", "pick", "running_sums", "same_keys_join", "sorted_blocks", "staged", "table"]

#: A word: a run of anything but ASCII white space.
ASCII_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, whatever other columns there are (also ones that differ in case alone)."""
    places = {}
    for i, c in enumerate(df.columns):
        places.setdefault(c, i)
    missing = [n for n in names if n not in places]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    plain = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"__c{places[n]}").alias(n) for n in names])


def sorted_blocks(df: DataFrame, keys: list[str], n: int | None = None) -> DataFrame:
    """Range partitions, each sorted. The keys should tell rows apart, so that no key value fills a partition."""
    n = n or partitions(df.sparkSession)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def running_sums(df: DataFrame, keys: list[str], value: str, group: str | None = None) -> DataFrame:
    """Adds `before` (long): the sum of `value` over the earlier rows in key order, within `group` if one is given, plus
    (`block`, `place`), which tell rows apart.

    With a group, it must be the first key. The table is range-partitioned by all keys; each block sums its rows, and only one
    row per block and group goes through a window. A hot group is spread over many blocks. The result is a written table.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("block", T.LongType()), T.StructField("place", T.LongType()), T.StructField("__in_block", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, place, last, carry = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column(value).to_numpy(zero_copy_only=False).astype("int64")
            sums = np.cumsum(values)
            own = sums - values
            if group is None:
                own += carry
                carry = int(own[-1] + values[-1])
            else:
                names = batch.column(group)
                codes = names.dictionary_encode("encode").indices.to_numpy()
                starts = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
                own -= np.repeat(own[starts], np.diff(starts, append=n))
                if last is not None and last == (names[0].as_py(),):
                    own[: starts[1] if len(starts) > 1 else n] += carry
                last, carry = (names[n - 1].as_py(),), int(own[-1] + values[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, block)), pa.array(np.arange(place, place + n)), pa.array(own)],
                                             names=[*batch.schema.names, "block", "place", "__in_block"])
            place += n

    rows = staged(sorted_blocks(df, keys).mapInArrow(add, schema), "running")
    by = [group] if group else []
    totals = rows.groupBy(*by, "block").agg(F.sum(value).alias("__total"))
    frame = f"sum(__total) over (partition by {', '.join(by) or '1'} order by block rows between unbounded preceding and 1 preceding)"
    offsets = staged(totals.select(*by, "block", F.expr(f"coalesce({frame}, 0L)").alias("__offset")), "offsets")
    joined = same_keys_join(rows, offsets, [*by, "block"])
    return joined.withColumn("before", F.col("__in_block") + F.col("__offset")).drop("__in_block", "__offset")


#: Bits of a key filter: 4 MB, at any input. Where it fills up it lets more rows pass, which the join behind it drops.
FILTER_BITS = 25
_FILTER_PIECES = 64
#: Tasks that join the pieces: a task costs more than the pieces it joins.
_FILTER_TASKS = 8


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One long key for two."""
    return (a.astype("int64").view("uint64") * np.uint64(0xD1342543DE82EF95) + b.astype("int64").view("uint64")).view("int64")


def key_filter(keys: DataFrame):
    """A broadcast bit table of one column of long keys, or of two (`combined`), to drop most rows that a join would drop before they
    are shuffled."""
    size = 1 << (FILTER_BITS - 3)
    piece = size // _FILTER_PIECES

    def rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"piece": pa.array(list(sums), pa.int32()), "bits": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype="uint8")
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            at = _filter_place(columns[0] if len(columns) == 1 else combined(*columns))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype("uint8"))
        pieces = bits.reshape(_FILTER_PIECES, piece)
        yield rows({i: pieces[i] for i in range(_FILTER_PIECES) if pieces[i].any()})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[p] = sums.get(p, np.zeros(piece, "uint8")) | np.frombuffer(raw, dtype="uint8")
        yield rows(sums)

    shape = "piece int, bits binary"
    table = bytearray(size)
    for row in keys.mapInArrow(mark, shape).repartition(_FILTER_TASKS, "piece").mapInArrow(join, shape).collect():  # 4 MB in all
        table[row.piece * piece:(row.piece + 1) * piece] = row.bits
    return keys.sparkSession.sparkContext.broadcast(bytes(table))


def _filter_place(keys: np.ndarray) -> np.ndarray:
    mixed = keys.astype("int64").view("uint64") * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS)).astype("int64")


def may_hold(table, keys: np.ndarray) -> np.ndarray:
    """Which keys a broadcast key_filter may hold: all that it was made of, and few others."""
    at = _filter_place(keys)
    return (np.frombuffer(table.value, dtype="uint8")[at >> 3] >> (at & 7).astype("uint8")) & 1 == 1


def filtered(df: DataFrame, key: str, table, hold: bool = True) -> DataFrame:
    """Rows whose key the filter may hold; with hold=False all others. Only the key goes to Python."""
    @F.arrow_udf("boolean")
    def keep(keys: pa.Array) -> pa.Array:
        return pa.array(may_hold(table, keys.to_numpy()) == hold)
    return df.where(keep(key))
