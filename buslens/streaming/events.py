"""Continuous ingestion of event files into an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from buslens.operators.events import ingest_events, normalize_events, validate_events


def event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the event files that arrive in a folder."""
    return spark.readStream.text(folder).select(
        "value", F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"))


def _stored(spark: SparkSession, table: str) -> DataFrame | None:
    """The event table; None only if its folder does not exist yet or holds no rows' files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path) or not any(not f.getPath().getName().startswith(("_", ".")) for f in files.listStatus(path)):
        return None
    return spark.read.parquet(table)


def start_ingest(spark: SparkSession, folder: str, table: str, rejects: str, checkpoint: str, **trigger):
    """Insert-or-ignore by event_id, exact for all time: every batch drops ids the table already has.

    A batch that is repeated after a failure finds its own rows and adds nothing.
    Rejected lines go to their own folder per batch, so a repeat overwrites them.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # file_time, file and the line order inside a file decide who comes first.
        rows = batch.withColumn("line_no", F.monotonically_increasing_id()).persist()
        try:
            fresh = ingest_events(rows, ["file_time", "file", "line_no"], _stored(session, table))
            fresh.drop("file_time", "file", "line_no").write.mode("append").parquet(table)
            bad = validate_events(rows).where(F.col("error").isNotNull()).select("value", "error")
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            rows.unpersist()

    return (event_lines(spark, folder).writeStream.foreachBatch(merge)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def bounded_dedup(lines: DataFrame, received_at: str, delay: str) -> DataFrame:
    """Weaker variant with bounded state: an id is only known as a copy within the delay."""
    valid = normalize_events(validate_events(lines), [received_at])
    return valid.withWatermark(received_at, delay).dropDuplicatesWithinWatermark(["event_id"])
