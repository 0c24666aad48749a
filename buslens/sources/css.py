"""Semicolon text with the header Timestamp;Type;ID;Data; all before the header is non-data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.frame import with_frame_checks
from buslens.functions.ids import STANDARD_ID_MAX, hex_id, payload_from_hex
from buslens.functions.time import trimmed, ts_css_ns
from buslens.plans.staging import same_keys_join, sized
from buslens.sources.lines import (ACCEPTED, NON_DATA, LogFormat, ParsedLog, classify, finish, lines_of, number_frames, scan_lines,
                                   split_table, stage_lines)

# Fixed header names.
HEADER = ["timestamp", "type", "id", "data"]


def is_header(fields: Column) -> Column:
    test = F.size(fields) >= len(HEADER)
    for i, name in enumerate(HEADER):
        test = test & F.coalesce(F.lower(trimmed(F.get(fields, F.lit(i)))) == name, F.lit(False))
    return test


def css_columns(lines: DataFrame) -> DataFrame:
    """Columns as if every line came after the header."""
    f, line = F.col("f"), F.col("line")

    def field(i: int) -> Column:
        return F.get(f, F.lit(i))

    rows = lines.withColumn("f", F.split(line, ";", -1)).withColumns({
        "is_header": is_header(f),
        "matched": F.size(f) >= 4,
        "raw_ns": ts_css_ns(field(0)),
        "type_code": F.when(trimmed(field(1)) == "", 0).otherwise(trimmed(field(1)).try_cast("int")),
        "can_id": hex_id(F.regexp_replace(trimmed(field(2)), "^0[xX]", "")),
        "payload": payload_from_hex(field(3)),
    }).withColumns({
        "non_data": (line == "") | line.startswith("#") | F.col("is_header"),
        "is_extended": F.col("type_code").isin(1, 3) | (F.col("can_id") > STANDARD_ID_MAX),
        "payload_len": F.octet_length("payload"),
        "declared": F.octet_length("payload"),
        "fd_marker": F.col("type_code") >= 2,
    })
    rows = with_frame_checks(rows)
    bad = (F.when(F.col("raw_ns").isNull(), "not a ddThhmmssmmm time")
           .when(F.col("type_code").isNull() | ~F.col("type_code").between(0, 3), "unknown frame type code")
           .when(F.col("can_id").isNull(), "identifier is not a 32-bit hex number")
           .when(F.col("payload").isNull(), "payload is not whole bytes")
           .otherwise(F.col("frame_error")))
    rows = classify(rows, bad, "CSS").withColumns({
        "time_ok": ~F.col("non_data") & F.col("matched") & F.col("raw_ns").isNotNull(),
        "frame_type": F.when(F.col("is_extended"), "Ext").otherwise("Std"),
        "channel": F.lit(""), "direction": F.lit("Unknown"), "kind": F.lit("Data"),
        "brs": F.lit(False), "esi": F.lit(False),
    })
    return rows.withColumn("reject_code", F.regexp_replace("reject_code", "_SYNTAX$", "_COLUMNS"))


CSS_FORMAT = LogFormat("css", css_columns, rebase=True)


def read_css(spark, path) -> ParsedLog:
    # Valid lines are counted in the scan, before the header is known; those above it come first in the file, so the file's count of them is taken off again.
    every = stage_lines(css_columns(scan_lines(spark, path)))
    place, valid = F.struct("split_start", "seq"), F.col("line_class") == ACCEPTED
    header = sized(every.where("is_header").groupBy("source_file").agg(F.min(place).alias("header_at")))
    after = F.coalesce(place > F.col("header_at"), F.lit(False))
    parsed = same_keys_join(every, header, ["source_file"], "left").withColumns({
        "above": valid & ~after,
        "line_class": F.when(after, F.col("line_class")).otherwise(NON_DATA),
        "time_ok": F.col("time_ok") & after,
    })
    splits = split_table(parsed)
    above = sized(parsed.groupBy("source_file").agg(F.count_if("above").alias("above")))
    frames = same_keys_join(number_frames(lines_of(parsed, ACCEPTED).drop("above"), splits), above, ["source_file"]).withColumns({
        "frame_index": F.col("frame_index") - F.col("above"),
        "ts_ns": F.col("raw_ns") - F.col("base_ns"),
    })
    return finish(splits, parsed, CSS_FORMAT, frames)
