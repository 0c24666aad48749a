"""BUSMASTER text: h:m:s:fraction Rx|Tx channel id type dlc bytes, with midnight rollover."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buslens.functions.frame import with_frame_checks
from buslens.functions.ids import STANDARD_ID_MAX, direction_of, hex_id, payload_from_pairs
from buslens.functions.time import NANOS_PER_DAY, ts_tod_ns
from buslens.sources.lines import (ACCEPTED, NON_DATA, SPLIT, LogFormat, ParsedLog, classify, finish, groups, lines_of, number_frames,
                                   scan_lines, split_table, stage_lines)

# Fixed line pattern: 1 time, 2 direction, 3 channel, 4 id, 5 type, 6 length, 7 bytes.
BUSMASTER = (r"^(\d{1,2}:\d{1,2}:\d{1,2}:\d{1,9})\s+(Rx|Tx)\s+(\S+)\s+(0x[0-9A-Fa-f]+|[0-9A-Fa-f]+)"
             r"\s+([A-Za-z]+)\s+(\d+)\s*((?:[0-9A-Fa-f]{2}\s*){0,64})$")


def busmaster_columns(lines: DataFrame) -> DataFrame:
    g, line = F.col("g"), F.col("line")
    rows = lines.withColumns({
        "non_data": (line == "") | line.startswith("***") | line.startswith("//") | line.startswith("#"),
        "g": groups(line, BUSMASTER, 7),
    }).withColumns({
        "matched": g.isNotNull(),
        "raw_ns": ts_tod_ns(g[0]),
        "frame_type": g[1],
        "direction": direction_of(g[1]),
        "channel": g[2],
        "can_id": hex_id(F.regexp_replace(g[3], "0[xX]", "")),
        "type_text": F.lower(g[4]),
        "declared": g[5].try_cast("int"),
        "payload": payload_from_pairs(g[6]),
    }).withColumns({
        "time_ok": ~F.col("non_data") & F.col("raw_ns").isNotNull(),
        "is_extended": F.col("type_text").contains("x") | (F.col("can_id") > STANDARD_ID_MAX),
        "payload_len": F.octet_length("payload"),
        "fd_marker": F.col("type_text").contains("fd"),
    })
    rows = with_frame_checks(rows)
    bad = (F.when(F.col("raw_ns").isNull(), "not a time of day")
           .when(F.col("declared").isNull(), "length is not a number")
           .when(F.col("payload").isNull(), "payload is not hex bytes")
           .when(F.col("can_id").isNull(), "identifier is not a 32-bit number")
           .otherwise(F.col("frame_error")))
    return classify(rows, bad, "BUSMASTER").withColumns({
        "kind": F.lit("Data"), "brs": F.lit(False), "esi": F.lit(False)})


BUSMASTER_FORMAT = LogFormat("busmaster", busmaster_columns, rebase=True)


def read_busmaster(spark, path) -> ParsedLog:
    """A drop of more than half a day starts the next day; a smaller drop only warns.

    The clock runs over every line with a readable time, valid frame or not: within a split in the scan, from split to split by
    the last time of each.
    """
    parsed = stage_lines(busmaster_columns(scan_lines(spark, path)), texts=F.col("line_class") != NON_DATA)
    splits = split_table(parsed)
    rows = number_frames(parsed.where("time_ok"), splits)
    rows = rows.withColumns({"prev": F.coalesce("prev_ns", "last_ns"), "day": F.col("days") + F.col("day_off")})
    # The first readable time has no day before it, so its time of day is the base.
    frames = lines_of(rows, ACCEPTED).withColumn("ts_ns", F.col("day") * NANOS_PER_DAY + F.col("raw_ns") - F.col("base_ns"))
    drop = F.col("prev") - F.col("raw_ns")
    warnings = rows.where((drop > 0) & (drop <= NANOS_PER_DAY // 2)).select(
        *SPLIT, "seq", F.lit("Warning").alias("severity"), F.lit("TIME_BACKWARDS").alias("code"),
        F.lit("time runs backwards within a day; source order is kept").alias("message"), "line_text")
    return finish(splits, parsed, BUSMASTER_FORMAT, frames, warnings)
