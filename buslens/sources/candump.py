"""candump text: (seconds) channel ID#DATA, or ID##<flags>DATA for CAN FD."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buslens.functions.frame import with_frame_checks
from buslens.functions.ids import STANDARD_ID_MAX, hex_id, payload_from_hex
from buslens.functions.time import ts_seconds_ns
from buslens.sources.lines import LogFormat, ParsedLog, classify, groups, read_format

# Fixed line pattern: 1 seconds, 2 channel, 3 id, 4 separator, 5 data.
CANDUMP = r"^\((\d+(?:\.\d+)?)\)\s+(\S+)\s+([0-9A-Fa-f]+)(##|#)([0-9A-Fa-f]*)$"


def candump_columns(lines: DataFrame) -> DataFrame:
    g = F.col("g")
    rows = lines.withColumns({
        "non_data": (F.col("line") == "") | F.col("line").startswith("#"),
        "g": groups(F.col("line"), CANDUMP, 5),
    }).withColumns({
        "matched": g.isNotNull(),
        "raw_ns": ts_seconds_ns(g[0]),
        "channel": g[1],
        "can_id": hex_id(g[2]),
        "fd_marker": g[3] == "##",
        "data": g[4],
    }).withColumns({
        "time_ok": ~F.col("non_data") & F.col("raw_ns").isNotNull(),
        "flags": F.when(F.col("fd_marker") & (F.length("data") > 0), F.conv(F.substring("data", 1, 1), 16, 10).cast("int")),
        "payload": payload_from_hex(F.when(F.col("fd_marker"), F.expr("substring(data, 2)")).otherwise(F.col("data"))),
    }).withColumns({
        "is_extended": F.col("can_id") > STANDARD_ID_MAX,
        "payload_len": F.octet_length("payload"),
        "declared": F.octet_length("payload"),
        "brs": F.coalesce(F.col("flags").bitwiseAND(F.lit(1)) != 0, F.lit(False)),
        "esi": F.coalesce(F.col("flags").bitwiseAND(F.lit(2)) != 0, F.lit(False)),
    })
    rows = with_frame_checks(rows)
    bad = (F.when(F.col("raw_ns").isNull(), "time is not exact in nanoseconds")
           .when(F.col("fd_marker") & F.col("flags").isNull(), "CAN FD flags missing")
           .when(F.col("payload").isNull(), "payload is not whole bytes")
           .when(F.col("can_id").isNull(), "identifier is not a 32-bit number")
           .otherwise(F.col("frame_error")))
    return classify(rows, bad, "CANDUMP").withColumns({
        "frame_type": F.lit(""),
        "direction": F.lit("Unknown"),
        "kind": F.lit("Data"),
    })


CANDUMP_FORMAT = LogFormat("candump", candump_columns, rebase=True)


def read_candump(spark, path) -> ParsedLog:
    return read_format(spark, path, CANDUMP_FORMAT)
