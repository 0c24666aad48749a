"""Usage events from files of newline JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from buslens.operators.events import ingest_events


def load_telemetry(spark, path, received_at: Column | None = None) -> DataFrame:
    """The event table of a folder of files: valid, normalised, the first of each id by file time, file and line."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))
    order = ["file_time", "file", "split", "place"]
    return ingest_events(lines, order, received_at=received_at).drop(*order)
