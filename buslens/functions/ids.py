"""Identifiers and payload text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from buslens.functions.time import trimmed

# Fixed values of the catalog and bus formats.
STANDARD_ID_MAX = 0x7FF
EXTENDED_ID_MAX = 0x1FFFFFFF
DBC_EXTENDED_FLAG = 0x80000000


def hex_id(text: Column) -> Column:
    """Hexadecimal text of an unsigned 32-bit number, else NULL."""
    return F.when(text.rlike("^0*[0-9A-Fa-f]{1,8}$"), F.conv(text, 16, 10).cast("bigint"))


def parse_id(text: Column) -> Column:
    """0x prefix or any letter A-F reads as hexadecimal, everything else as decimal."""
    t = trimmed(text)
    decimal = F.when(t.rlike(r"^\+?0*[0-9]{1,10}$"), t.try_cast("bigint"))
    return (F.when(t.rlike("^0[xX]"), hex_id(F.substring(t, 3, 1_000_000)))
            .when(t.rlike("[A-Fa-f]"), hex_id(t))
            .when(decimal <= 0xFFFFFFFF, decimal))


def payload_from_hex(text: Column) -> Column:
    """Contiguous hex digits, optional 0x, to bytes; NULL if odd or not hex."""
    t = F.regexp_replace(trimmed(text), "^0[xX]", "")
    return F.when(F.length(t) % 2 == 0, F.unhex(t))


def payload_from_pairs(text: Column) -> Column:
    """Two-digit hex bytes separated by spaces, to bytes; else NULL."""
    t = trimmed(text)
    return F.when(t.rlike(r"^(?:[0-9A-Fa-f]{2}(?:\s* \s*[0-9A-Fa-f]{2})*)?$"), F.unhex(F.regexp_replace(t, r"\s+", "")))


def byte_token(token: Column) -> Column:
    """One or two hex digits, optional 0x, as two hex digits; else NULL."""
    t = F.regexp_replace(trimmed(token), "^0[xX]", "")
    return F.when(t.rlike("^[0-9A-Fa-f]{1,2}$"), F.lpad(t, 2, "0"))


def hex_token(text: Column) -> Column:
    """Normal form of a hex search text."""
    return F.upper(F.regexp_replace(F.regexp_replace(trimmed(F.coalesce(text, F.lit(""))), " ", ""), "^0[xX]", ""))


def normalize_dbc_id(can_id: Column, is_extended: Column) -> Column:
    """Bus id without the catalog's extended flag."""
    return F.when(is_extended, can_id.bitwiseAND(F.lit(EXTENDED_ID_MAX))).otherwise(can_id)


def j1939_pgn(frame_id: Column) -> Column:
    """Parameter group of a 29-bit id; a destination-specific group drops its PS byte."""
    pf = F.shiftright(frame_id, 16).bitwiseAND(F.lit(0xFF))
    ps = F.shiftright(frame_id, 8).bitwiseAND(F.lit(0xFF))
    page = F.shiftright(frame_id, 24).bitwiseAND(F.lit(1))
    pgn = page * 65536 + pf * 256 + F.when(pf >= 240, ps).otherwise(F.lit(0))
    return F.when(frame_id > STANDARD_ID_MAX, pgn)


def direction_of(text: Column) -> Column:
    low = F.lower(text)
    return (F.when(low.contains("tx"), F.lit("Transmit"))
            .when(low.contains("rx"), F.lit("Receive")).otherwise(F.lit("Unknown")))
