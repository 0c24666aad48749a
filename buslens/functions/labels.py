"""Readable labels and value classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from buslens.functions.frame import blank_as


def signal_label() -> Column:
    """Msg.Sig [channel | CAN or FD | Std or Ext | 0xID] from the identity columns."""
    return F.concat(
        F.col("message_name"), F.lit("."), F.col("signal_name"), F.lit(" ["), blank_as(F.col("channel"), "?"),
        F.lit(" | "), F.when(F.col("frame_format") == "FlexibleDataRate", "FD").otherwise("CAN"),
        F.lit(" | "), F.when(F.col("is_extended"), "Ext").otherwise("Std"),
        F.lit(" | 0x"), F.hex(F.col("frame_id")), F.lit("]"))


def short_label(label: Column) -> Column:
    """The part after the first dot and before ' ['."""
    tail = F.regexp_extract(label, r"(?s)^[^.]*\.(.+)$", 1)
    return F.when(tail == "", label).otherwise(F.regexp_replace(tail, r"(?s) \[.*$", ""))


def count_bucket(n: Column) -> Column:
    # Fixed class names.
    return (F.when(n <= 0, "0").when(n <= 10, "1-10").when(n <= 100, "11-100").when(n <= 1_000, "101-1k")
            .when(n <= 10_000, "1k-10k").when(n <= 100_000, "10k-100k").when(n <= 1_000_000, "100k-1m")
            .when(n <= 10_000_000, "1m-10m").when(n.isNotNull(), "10m+"))


def duration_bucket(ms: Column) -> Column:
    # Fixed class names.
    return (F.when(ms < 1_000, "<1s").when(ms < 5_000, "1s-5s").when(ms < 15_000, "5s-15s")
            .when(ms < 60_000, "15s-1m").when(ms < 300_000, "1m-5m").when(ms < 900_000, "5m-15m")
            .when(ms.isNotNull(), "15m+"))


def sensitivity_advice() -> Column:
    """What the pair statistics suggest about the stick's tuning."""
    c = F.col
    text = F.concat_ws(
        "; ",
        F.when((c("used_x_range_pct") < 45) | (c("used_y_range_pct") < 45), "range barely used: raise sensitivity or expo"),
        F.when(c("deadzone_pct") > 40, "long dwell in deadzone: reduce deadzone or raise gain"),
        F.when(c("saturation_pct") > 15, "often at end stop: lower sensitivity or limit output"),
        F.when((F.abs(c("bias_x")) > 0.15) | (F.abs(c("bias_y")) > 0.15), "centre offset: calibrate"))
    return F.when(text == "", F.lit("settings look healthy")).otherwise(text)
