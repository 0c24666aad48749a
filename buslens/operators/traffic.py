"""Bus load, frame rates and cycle times per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from buslens.functions.frame import frame_duration, time_s
from buslens.operators.ordered import ordered
from buslens.plans.staging import MAX_GROUP_ROWS, same_keys_join, sized
from buslens.schema import STREAM_COLS

#: Bins of one row of the grid; more rows follow.
GRID_STEP = 100_000
STREAM = STREAM_COLS


def _of_files(frames: DataFrame) -> DataFrame:
    return frames if "source_file" in frames.columns else frames.withColumn("source_file", F.lit(""))


def time_bins(frames: DataFrame, bin_ms: float = 100) -> DataFrame:
    """Per file: start, duration, bin width and number of bins."""
    if bin_ms <= 0:
        raise ValueError("bin_ms must be positive")
    t = time_s(F.col("ts_ns"))
    width = bin_ms / 1000.0
    span = _of_files(frames).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("frames"), F.min(t).alias("start_s"), F.max(t).alias("end_s"))
    span = span.withColumn("duration_s", F.greatest(F.lit(1e-9), F.col("end_s") - F.col("start_s")))
    return sized(span.withColumns({
        "bin_s": F.lit(width), "bins": F.greatest(F.lit(1).cast("long"), F.ceil(F.col("duration_s") / width) + 1)}).drop("end_s"))


def _binned(frames: DataFrame, spans: DataFrame, kbps: float, data_kbps: float) -> DataFrame:
    """Frames and bus seconds per bin that has frames."""
    busy = frame_duration(F.col("frame_format"), F.col("is_extended"), F.col("payload_len"), F.col("brs"),
                          max(50, kbps) * 1000.0, max(50, data_kbps) * 1000.0)
    rows = same_keys_join(_of_files(frames), spans, ["source_file"])
    at = F.floor((time_s(F.col("ts_ns")) - F.col("start_s")) / F.col("bin_s"))
    return rows.groupBy("source_file", F.least(F.greatest(at, F.lit(0)), F.col("bins") - 1).alias("bin")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum(busy).alias("busy_s"))


def bus_trend(frames: DataFrame, *, bin_ms: float = 100, kbps: float = 500, data_kbps: float = 2000) -> DataFrame:
    """Frames per second and estimated load per time bin, empty bins included."""
    spans = time_bins(frames, bin_ms)
    # A file's grid is made in steps, so that no row holds all of it.
    step = F.lit(GRID_STEP).cast("long")
    grid = spans.select("source_file", "start_s", "bin_s", "bins", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1, step)).alias("from"))
    grid = grid.select("source_file", "start_s", "bin_s", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + step, F.col("bins")) - 1)).alias("bin"))
    filled = same_keys_join(grid, _binned(frames, spans, kbps, data_kbps), ["source_file", "bin"], "left")
    n, busy = F.coalesce("frames", F.lit(0)), F.coalesce("busy_s", F.lit(0.0))
    return filled.select("source_file", "bin", (F.col("start_s") + F.col("bin") * F.col("bin_s")).alias("time_s"),
                         n.alias("frames"), (n / F.col("bin_s")).alias("frames_per_s"),
                         (busy / F.col("bin_s") * 100.0).alias("load_pct"))


def stream_counts(frames: DataFrame) -> DataFrame:
    """Frames and payload bytes per traffic stream."""
    return _of_files(frames).groupBy(*STREAM).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("payload_len").alias("payload_bytes"))


def bus_overview(frames: DataFrame, *, bin_ms: float = 100, kbps: float = 500, data_kbps: float = 2000,
                 max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """One row per file: totals, rates, load and time-order faults."""
    spans = time_bins(frames, bin_ms)
    text = F.lower("frame_type")
    flags = _of_files(frames).groupBy("source_file").agg(
        F.count_if("is_extended").alias("extended_frames"),
        F.count_if(text.contains("err")).alias("error_frames"),
        F.count_if(text.contains("rtr") | text.contains("remote")).alias("remote_frames"))
    streams = stream_counts(frames)
    ids = streams.groupBy("source_file").agg(
        F.countDistinct("can_id").alias("unique_ids"), F.count(F.lit(1)).alias("unique_streams"))
    load = _binned(frames, spans, kbps, data_kbps).groupBy("source_file").agg(
        F.max("frames").alias("peak_frames"), F.max("busy_s").alias("peak_busy_s"), F.sum("busy_s").alias("busy_s"))
    negative = cycle_stats(frames, max_group_rows=max_group_rows).groupBy("source_file").agg(
        F.sum("negative_cycles").alias("negative_cycles"))
    row = spans
    for part in (flags, ids, load, negative):
        row = same_keys_join(row, part, ["source_file"], "left")
    d, w = F.col("duration_s"), F.col("bin_s")
    return row.select(
        "source_file", "duration_s", "frames", "unique_ids", "unique_streams", "extended_frames", "error_frames",
        "remote_frames", (F.col("frames") / d).alias("avg_frames_per_s"), (F.col("peak_frames") / w).alias("peak_frames_per_s"),
        (F.col("busy_s") / d * 100.0).alias("avg_load_pct"), (F.col("peak_busy_s") / w * 100.0).alias("peak_load_pct"),
        F.coalesce("negative_cycles", F.lit(0)).alias("negative_cycles"))


def top_ids(frames: DataFrame, limit: int = 30) -> DataFrame:
    """The busiest streams of each file with their share of its frames."""
    rows = stream_counts(frames)
    totals = sized(rows.groupBy("source_file").agg(F.sum("frames").alias("all_frames")))
    rows = same_keys_join(rows, totals, ["source_file"])
    rows = rows.select(*STREAM, "frames", (F.col("frames") * 100.0 / F.col("all_frames")).alias("share_pct"),
                       (F.col("payload_bytes") / F.col("frames")).alias("mean_payload_len"))
    return _first_of_file(rows, [F.desc("frames"), *_TIES], limit)


_TIES = ["channel", "can_id", "direction", "frame_format", "is_extended"]


def _first_of_file(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows of each file, in that order; one row per stream is ranked."""
    place = F.row_number().over(Window.partitionBy("source_file").orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= limit).orderBy("source_file", "__place").drop("__place")


def cycle_times(frames: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Milliseconds since the previous frame of the stream, in source order, so time faults show as negative."""
    rows = _of_files(frames).select(*STREAM, "frame_index", "ts_ns")
    o = ordered(rows, STREAM, ["frame_index"], max_group_rows=max_group_rows).lag(prev_ns="ts_ns")
    return o.select(cycle_ms=(time_s(F.col("ts_ns")) - time_s(F.col("prev_ns"))) * 1000.0).done().drop("prev_ns")


def cycle_stats(frames: DataFrame, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    c = F.col("cycle_ms")
    return cycle_times(frames, max_group_rows=max_group_rows).where(c.isNotNull()).groupBy(*STREAM).agg(
        F.count(c).alias("cycles"), F.avg(c).alias("mean_cycle_ms"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("jitter_ms"),
        F.min(c).alias("min_cycle_ms"), F.max(c).alias("max_cycle_ms"), F.count_if(c < 0).alias("negative_cycles"))


def cycle_timing(frames: DataFrame, limit: int = 40, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The streams of each file with the largest jitter."""
    return _first_of_file(cycle_stats(frames, max_group_rows=max_group_rows), [F.desc("jitter_ms"), F.desc("cycles"), *_TIES], limit)
