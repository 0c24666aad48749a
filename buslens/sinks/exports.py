"""Writing decoded samples and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.frame import time_s
from buslens.functions.labels import signal_label
from buslens.operators.events import export_rows
from buslens.plans.staging import same_keys_join
from buslens.schema import present


def export_join(samples: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Samples with the length code and payload length of their frame, 0 where the frame is missing. Samples that carry both from decoding need no
    join; others get them from `frames`."""
    if {"dlc_code", "payload_length"} <= set(samples.columns):
        return samples.fillna(0, ["dlc_code", "payload_length"])
    if frames is None:
        raise ValueError("samples without dlc_code and payload_length need their frames")
    keys = [c for c in ["source_file", "frame_index"] if c in samples.columns and c in frames.columns]
    sizes = frames.select(*keys, F.col("dlc").alias("dlc_code"), F.col("payload_len").alias("payload_length"))
    return same_keys_join(samples, sizes, keys, "left").withColumns({
        "dlc_code": F.coalesce("dlc_code", F.lit(0)), "payload_length": F.coalesce("payload_length", F.lit(0))})


def decoded_export(samples: DataFrame, frames: DataFrame | None, meta: dict[str, str | None]) -> DataFrame:
    """The 22 export columns. meta: dataset_status, source_log_sha256, dbc_sha256, app_version, import_mode."""
    rows = export_join(samples, frames)
    named: dict[str, Column] = {
        "time_s": time_s(F.col("ts_ns")), "frame_id": F.col("frame_id"), "message_name": F.col("message_name"),
        "signal_name": F.col("signal_name"), "value": F.col("value"), "label": signal_label(), "time_ns": F.col("ts_ns"),
        "frame_index": F.col("frame_index"), "source_line": F.col("source_line"), "channel": F.col("channel"),
        "frame_format": F.col("frame_format"), "is_extended": F.col("is_extended"), "dlc_code": F.col("dlc_code"),
        "payload_length": F.col("payload_length"), "raw_value": F.coalesce(F.col("raw_value").cast("string"), *[F.col("raw_hex")] * ("raw_hex" in rows.columns)), "unit": F.col("unit"),
        "decode_quality": F.col("quality"),
    }
    named.update({c: F.lit(meta.get(c) or "") for c in
                  ("dataset_status", "source_log_sha256", "dbc_sha256", "app_version", "import_mode")})
    return rows.select(*[c.alias(n) for n, c in named.items()])


def export_decoded(samples: DataFrame, frames: DataFrame | None, meta: dict[str, str | None], path: str) -> None:
    """CSV folder with a header per part. Doubles are written in their shortest exact form."""
    decoded_export(samples, frames, meta).write.option("header", True).csv(path)


def export_ndjson(events: DataFrame, path: str, after: Column | None = None, limit: int | None = None) -> None:
    """Newline JSON of the events after a receive time, oldest first."""
    rows = export_rows(events, after, limit).select(F.col("event_json").alias("value"))
    rows.write.text(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Parquet table laid out for reading single signals: clustered by identity and time.

    Range partitioning by the full order also spreads a signal that dominates the data.
    """
    keys = present(samples, ["source_file", "message_name", "signal_name", "channel", "ts_ns", "frame_index"])
    samples.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
