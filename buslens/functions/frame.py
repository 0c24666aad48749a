"""Checks and derived columns of one bus frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.ids import EXTENDED_ID_MAX, STANDARD_ID_MAX

# Payload bytes for each CAN FD length code 0..15.
FD_LENGTHS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 20, 24, 32, 48, 64]
CLASSIC, FD = "Classic", "FlexibleDataRate"


def with_frame_checks(rows: DataFrame) -> DataFrame:
    """Add frame_format, dlc (length code 0..15) and frame_error (NULL for a valid frame).

    Needs can_id, is_extended, payload_len, declared and fd_marker. The declared
    value of a CAN FD frame may be its length code or its byte length.
    """
    n, declared = F.col("payload_len"), F.col("declared")
    fd = F.col("frame_format") == FD
    code, code_len = F.col("len_code"), F.col("declared_len")
    return rows.withColumns({
        "frame_format": F.when(F.col("fd_marker") | (n > 8) | (declared > 8), FD).otherwise(CLASSIC),
        "len_code": F.array_position(F.lit(FD_LENGTHS), n.cast("int")).cast("int") - 1,
        "declared_len": F.get(F.lit(FD_LENGTHS), F.when(declared.between(0, 15), declared.cast("int"))),
        "in_range": F.col("can_id") <= F.when(F.col("is_extended"), EXTENDED_ID_MAX).otherwise(STANDARD_ID_MAX),
    }).withColumns({
        "dlc": F.when(fd, code).otherwise(declared.cast("int")),
        "frame_error": F.when(~F.col("in_range"), "identifier out of range")
        .when(~n.between(0, 64), "payload length out of range")
        .when(~fd & ((declared < 0) | (declared != n)), "length code does not match payload")
        .when(fd & (code < 0), "payload length has no CAN FD code")
        .when(fd & (declared != n) & ~F.coalesce(code_len == n, F.lit(False)),
              "declared CAN FD length does not match payload"),
    }).drop("len_code", "declared_len", "in_range")


def time_s(ts_ns: Column) -> Column:
    return ts_ns / F.lit(1e9)


def id_hex(can_id: Column) -> Column:
    return F.concat(F.lit("0x"), F.hex(can_id))


def data_hex(payload: Column) -> Column:
    """Bytes as two-digit hex separated by spaces."""
    return F.rtrim(F.regexp_replace(F.hex(payload), "(..)", "$1 "))


def data_ascii(payload: Column) -> Column:
    """Printable bytes as text, a dot for the rest."""
    latin = F.decode(payload, "ISO-8859-1")
    return F.regexp_replace(latin, r"(?s)[^\x20-\x7E]", ".")


def message_type(fmt: Column, is_extended: Column) -> Column:
    return F.concat(F.when(fmt == FD, F.lit("FD")).otherwise(F.lit("CAN")), F.lit("/"),
                    F.when(is_extended, F.lit("Ext")).otherwise(F.lit("Std")))


def blank_as(text: Column, other: str) -> Column:
    return F.when(text.isNull() | text.rlike(r"^\s*$"), F.lit(other)).otherwise(text)


def with_frame_projections(frames):
    """Readable columns next to the stored ones."""
    return frames.withColumns({
        "time_s": time_s(F.col("ts_ns")),
        "id_hex": id_hex(F.col("can_id")),
        "data_hex": data_hex(F.col("payload")),
        "data_ascii": data_ascii(F.col("payload")),
        "message_type": message_type(F.col("frame_format"), F.col("is_extended")),
        "channel_text": blank_as(F.col("channel"), "1"),
        "direction_text": F.when(F.col("direction") == "Transmit", "Tx")
                           .when(F.col("direction") == "Receive", "Rx").otherwise("?"),
    })


def frame_duration(fmt: Column, is_extended: Column, payload_len: Column, brs: Column,
                   arbitration_bps: float, data_bps: float) -> Column:
    """Estimated seconds on the wire; 1.2 stands for bit stuffing."""
    stuff, arb, data = 1.2, float(arbitration_bps), float(data_bps)
    head = F.when(is_extended, F.lit(67)).otherwise(F.lit(47))
    classic = (head + payload_len * 8 + 3) * stuff / arb
    fd_head = F.when(is_extended, F.lit(41)).otherwise(F.lit(23))
    fd_body = payload_len * 8 + F.when(payload_len <= 16, F.lit(17)).otherwise(F.lit(21)) + 13
    fd = fd_head * stuff / arb + fd_body * stuff / F.when(brs, F.lit(data)).otherwise(F.lit(arb))
    return F.when(fmt == FD, fd).otherwise(classic)
