"""Column layouts shared by the sources, operators and plans.

Time is integer nanoseconds (BIGINT): Spark timestamps stop at microseconds.
Ids are BIGINT because the catalog's extended flag (0x80000000) overflows INT.
"""

from __future__ import annotations

from pyspark.sql import types as T

FRAME_COLS = [
    "source_file", "frame_index", "source_line", "ts_ns", "can_id", "is_extended", "dlc", "payload",
    "payload_len", "frame_type", "channel", "frame_format", "direction", "kind", "brs", "esi",
]
ISSUE_COLS = ["source_file", "severity", "code", "parser", "source_line", "message", "line_text"]

# A signal is identified by all of these; the readable label is never a key.
IDENTITY_COLS = [
    "source_file", "channel", "frame_format", "is_extended", "frame_id", "message_name", "signal_name",
]
# A traffic stream: every frame with the same id on the same channel and direction.
STREAM_COLS = ["source_file", "channel", "direction", "frame_format", "is_extended", "can_id"]
SERIES_ORDER = ["ts_ns", "frame_index"]

MUX_RANGE = T.StructType([
    T.StructField("mux", T.StringType()),
    T.StructField("lo", T.LongType()),
    T.StructField("hi", T.LongType()),
])
DBC_MESSAGES = T.StructType([
    T.StructField("msg_order", T.IntegerType()),
    T.StructField("raw_frame_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("dlc", T.IntegerType()),
])
DBC_SIGNALS = T.StructType([
    T.StructField("msg_order", T.IntegerType()),
    T.StructField("sig_order", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("start_bit", T.IntegerType()),
    T.StructField("length", T.IntegerType()),
    T.StructField("little_endian", T.BooleanType()),
    T.StructField("is_signed", T.BooleanType()),
    T.StructField("scale", T.DoubleType()),
    T.StructField("offset", T.DoubleType()),
    T.StructField("minimum", T.DoubleType()),
    T.StructField("maximum", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("is_mux", T.BooleanType()),
    T.StructField("mux_ids", T.ArrayType(T.IntegerType())),
    T.StructField("mux_ranges", T.ArrayType(MUX_RANGE)),
    T.StructField("value_kind", T.StringType()),
])

NANOS = 1_000_000_000


def present(df, cols):
    """The given key columns that the DataFrame has, in the given order."""
    have = set(df.columns)
    return [c for c in cols if c in have]
