"""Tolerant reading of unknown text: the first time, id, length, bytes run that validates.

Only on explicit request; format detection never picks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buslens.functions.frame import FD_LENGTHS, with_frame_checks
from buslens.functions.ids import EXTENDED_ID_MAX, STANDARD_ID_MAX, byte_token, direction_of, parse_id
from buslens.functions.time import trimmed, ts_seconds_ns
from buslens.sources.lines import LogFormat, ParsedLog, classify, read_format
from buslens.sources.peak import header_or_comment

# Fixed search ranges: time among the first tokens, id after it, length after the id.
TIME_TOKENS, ID_STEPS, LENGTH_STEPS = 5, 7, 5


def _positions():
    """Candidate positions (time, id, length) in the order in which they are tried."""
    return F.lit([[t, t + i, t + i + d] for t in range(TIME_TOKENS)
                  for i in range(1, ID_STEPS + 1) for d in range(1, LENGTH_STEPS + 1)])


def generic_columns(lines: DataFrame) -> DataFrame:
    tokens = F.col("tokens")
    last = TIME_TOKENS + ID_STEPS + LENGTH_STEPS
    rows = lines.withColumn("tokens", F.filter(F.split("line", " "), lambda x: x != "")).withColumns({
        "times": F.transform(F.slice(tokens, 1, TIME_TOKENS), ts_seconds_ns),
        "ids": F.transform(F.slice(tokens, 1, last), lambda x: F.when(~F.lower(x).isin("rx", "tx"), parse_id(x))),
        "lengths": F.transform(F.slice(tokens, 1, last), lambda x: F.when(
            trimmed(x).rlike(r"^[+-]?\d+$"), trimmed(x).try_cast("int"))),
        "bytes": F.transform(tokens, byte_token),
    })

    def bytes_after(at, n):
        return F.slice(F.col("bytes"), at + 2, n)

    def fits(p):
        n, can_id = F.get(F.col("lengths"), p[2]), F.get(F.col("ids"), p[1])
        ok = (F.get(F.col("times"), p[0]).isNotNull() & (can_id <= EXTENDED_ID_MAX) & n.isin(FD_LENGTHS)
              & (p[2] + 1 + n <= F.size(tokens)) & F.forall(bytes_after(p[2], F.greatest(n, F.lit(0))), lambda b: b.isNotNull()))
        return F.coalesce(ok, F.lit(False))

    hit = F.col("hit")
    rows = rows.withColumn("hit", F.when(F.size(tokens) >= 4, F.get(F.filter(_positions(), fits), F.lit(0)))).withColumns({
        "raw_ns": F.get(F.col("times"), hit[0]),
        "can_id": F.get(F.col("ids"), hit[1]),
        "declared": F.get(F.col("lengths"), hit[2]),
        "non_data": header_or_comment(F.col("line")),
        "matched": hit.isNotNull(),
        "frame_type": F.coalesce(F.get(F.filter(tokens, lambda x: F.lower(x).isin("rx", "tx")), F.lit(0)), F.lit("")),
    }).withColumns({
        "payload": F.unhex(F.array_join(bytes_after(hit[2], F.col("declared")), "")),
        "payload_len": F.col("declared"),
        "is_extended": F.col("can_id") > STANDARD_ID_MAX,
        "fd_marker": F.col("declared") > 8,
        "direction": direction_of(F.col("frame_type")),
        "time_ok": F.col("raw_ns").isNotNull(),
        "channel": F.lit(""), "kind": F.lit("Data"), "brs": F.lit(False), "esi": F.lit(False),
    })
    return classify(with_frame_checks(rows), F.col("frame_error"), "GENERIC")


GENERIC_FORMAT = LogFormat("generic", generic_columns, rebase=False)


def read_generic(spark, path) -> ParsedLog:
    return read_format(spark, path, GENERIC_FORMAT)
