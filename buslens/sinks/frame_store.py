"""Frame tables laid out for reading little of them: pages at any offset, and the frames of one id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from buslens.schema import present

_RANK = "__rank"


def write_ranked(frames: DataFrame, path: str) -> None:
    """Frames in source order, with an index of one row per file: how many frames lie before it.

    `rows` is range-partitioned by (source_file, frame_index), so a file holds frames in a row. Each has a number that grows in source order
    and has gaps only between files. `index` holds file, first (the number of the file's first frame), rows and before.
    """
    spark, order = frames.sparkSession, present(frames, ["source_file", "frame_index"])
    rows = frames.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.withColumn(_RANK, F.monotonically_increasing_id()).write.parquet(f"{path}/rows")
    files = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(_RANK).alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).write.parquet(f"{path}/index")


def ranked_count(spark: SparkSession, path: str) -> int:
    """Frames of a ranked table, by its index alone."""
    return spark.read.parquet(f"{path}/index").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def ranked_page(spark: SparkSession, path: str, offset: int = 0, max_rows: int = 50_000) -> DataFrame:
    """One page of a ranked table in source order, as `page_frames` gives it. Only the files that the page touches are opened, and of them only the
    row groups with its numbers are read, whatever the offset."""
    start, size = max(0, offset), max(1, max_rows)
    index = spark.read.parquet(f"{path}/index")
    # As many rows as the page touches files.
    hits = index.where((F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)).orderBy("before").collect()
    if not hits:
        return spark.read.parquet(f"{path}/rows").drop(_RANK).limit(0)
    low, high = hits[0], hits[-1]
    rows = spark.read.parquet(*[f"{path}/rows/{hit.file}" for hit in hits]).where(
        F.col(_RANK).between(low.first + max(0, start - low.before), high.first + min(high.rows, start + size - high.before) - 1))
    return rows.orderBy(_RANK).drop(_RANK)


def write_by_id(frames: DataFrame, path: str, group_bytes: int = 16 << 20) -> None:
    """Frames clustered by id and time. Readers that ask for an id, alone or with a time window, skip the row groups without it: by their smallest
    and largest values, and by a Bloom filter of ids. Ranges are cut by time and frame as well, so that a dominating id is spread over many files."""
    keys = present(frames, ["can_id", "ts_ns", "source_file", "frame_index"])
    frames.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("parquet.block.size", group_bytes).option(
        "parquet.bloom.filter.enabled#can_id", True).parquet(path)
