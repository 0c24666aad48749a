"""PEAK .trc text: tab-separated or classic columns, milliseconds, absolute time."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.frame import with_frame_checks
from buslens.functions.ids import STANDARD_ID_MAX, direction_of, hex_id, payload_from_pairs
from buslens.functions.time import trimmed, ts_millis_ns
from buslens.sources.lines import LogFormat, ParsedLog, classify, groups, read_format

# Fixed line patterns.
# Tab-separated: 1 time, 2 and 3 columns of which 2 is the channel, 4 id, 5 length, 6 bytes, 7 tail.
PEAK_TSV = (r"^\s*(\d+(?:[.,]\d+)?)\t([^\t]*)\t([^\t]*)\t([0-9A-Fa-f]+)\t(\d+)\t"
            r"((?:[0-9A-Fa-f]{2}(?:\s+[0-9A-Fa-f]{2})*)?)\t(.*)$")
# Classic: 1 counter, 2 time, 3 direction, 4 id, 5 length, 6 bytes.
PEAK_CLASSIC = (r"^\s*(\d+\))?\s*(\d+(?:[.,]\d+)?)\s+(Rx|Tx|DT|FD)?\s*([0-9A-Fa-f]+)\s+(\d+)\s+"
                r"((?:[0-9A-Fa-f]{2}\s*){0,64})$")
# Lines with these prefixes carry no data.
HEADER_PREFIXES = [";", "//", "#", "date", "base", "internal", "Begin", "End"]


def header_or_comment(line: Column) -> Column:
    test = line == ""
    for prefix in HEADER_PREFIXES:
        test = test | line.startswith(prefix)
    return test


def peak_columns(lines: DataFrame, ext_rule: str) -> DataFrame:
    line, t, c = F.col("line"), F.col("t"), F.col("c")
    is_tsv = t.isNotNull()

    def either(tsv: int, classic: int) -> Column:
        return F.when(is_tsv, t[tsv]).otherwise(c[classic])

    rows = lines.withColumns({
        "non_data": header_or_comment(line) | line.startswith("@ "),
        "t": groups(line, PEAK_TSV, 7),
        "c": groups(line, PEAK_CLASSIC, 6),
    }).withColumns({
        "matched": is_tsv | c.isNotNull(),
        "raw_ns": ts_millis_ns(either(0, 1)),
        "can_id": hex_id(either(3, 3)),
        "declared": either(4, 4).try_cast("int"),
        "payload": payload_from_pairs(either(5, 5)),
        "tail": F.lower(either(6, 2)),
        "channel": F.when(is_tsv, trimmed(t[1])).otherwise(""),
    })
    has_x = F.col("tail").contains("x") if ext_rule == "literal" else F.col("tail").rlike(r"(^|[^a-z0-9])x([^a-z0-9]|$)")
    rows = with_frame_checks(rows.withColumns({
        "time_ok": ~F.col("non_data") & F.col("raw_ns").isNotNull(),
        "is_extended": has_x | (F.col("can_id") > STANDARD_ID_MAX),
        "payload_len": F.octet_length("payload"),
        "fd_marker": F.col("tail").contains("fd"),
        "direction": direction_of(F.col("tail")),
    }))
    bad = (F.when(F.col("raw_ns").isNull(), "time is not exact in nanoseconds")
           .when(F.col("declared").isNull(), "length is not a number")
           .when(F.col("payload").isNull(), "payload is not hex bytes")
           .when(F.col("can_id").isNull(), "identifier is not a 32-bit number")
           .otherwise(F.col("frame_error")))
    return classify(rows, bad, "PEAK").withColumns({
        "frame_type": F.when(F.col("direction") == "Transmit", "Tx").when(F.col("direction") == "Receive", "Rx").otherwise(""),
        "kind": F.lit("Data"), "brs": F.lit(False), "esi": F.lit(False)})


def peak_format(ext_rule: str = "token") -> LogFormat:
    """ext_rule: "token" wants a stand-alone x; "literal" takes any x, so also the one in Rx and Tx."""
    if ext_rule not in ("token", "literal"):
        raise ValueError(f"unknown ext_rule {ext_rule!r}")
    return LogFormat("peak", partial(peak_columns, ext_rule=ext_rule), rebase=False)


def read_peak_trc(spark, path, ext_rule: str = "token") -> ParsedLog:
    return read_format(spark, path, peak_format(ext_rule))
