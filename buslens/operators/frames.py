"""Selecting and paging frames, and the message view."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.frame import data_hex, id_hex, time_s
from buslens.plans.staging import same_keys_join
from buslens.schema import present

def parse_id_literal(text: str) -> int | None:
    """The id a search text stands for: hexadecimal with 0x or a letter A-F, else decimal; None if neither."""
    t = text.strip()
    is_hex = t.lower().startswith("0x") or re.search("[A-Fa-f]", t)
    digits = t[2:] if t.lower().startswith("0x") else t
    if not re.fullmatch("[0-9A-Fa-f]+" if is_hex else r"\+?[0-9]+", digits):
        return None
    value = int(digits, 16 if is_hex else 10)
    return value if value <= 0xFFFFFFFF else None


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(column).contains(text.lower())


def within_time(rows: DataFrame, start: float | None, end: float | None) -> DataFrame:
    """Rows from start to end (seconds, both included). Slightly wider whole nanoseconds go to the scan, the exact test stays on top."""
    ts = F.col("ts_ns")
    for bound, sign in ((start, -1), (end, 1)):
        if bound is not None:
            rows = rows.where(time_s(ts) >= float(bound) if sign < 0 else time_s(ts) <= float(bound))
            slack = bound * 1e9 + sign * (abs(bound) * 1e-3 + 1e3)
            if abs(slack) < 2**62:
                rows = rows.where(ts >= int(slack) if sign < 0 else ts <= int(slack))
    return rows


def filter_frames(frames: DataFrame, *, id_text: str | None = None, payload_hex: str | None = None,
                  type_text: str | None = None, channel_text: str | None = None, time_start: float | None = None,
                  time_end: float | None = None, is_extended: bool | None = None) -> DataFrame:
    """All given conditions hold; the time window includes both ends (seconds)."""
    out = frames
    if id_text and id_text.strip():
        number = parse_id_literal(id_text)
        out = out.where(F.col("can_id") == number if number is not None
                        else contains_text(id_hex(F.col("can_id")), id_text.strip()))
    if payload_hex and payload_hex.strip():
        token = re.sub("^0[xX]", "", payload_hex.strip().replace(" ", "")).upper()
        if token:
            out = out.where(F.hex("payload").contains(token))
    if type_text and type_text.strip():
        out = out.where(contains_text(F.col("frame_type"), type_text))
    if channel_text and channel_text.strip():
        out = out.where(contains_text(F.col("channel"), channel_text))
    out = within_time(out, time_start, time_end)
    if is_extended is not None:
        out = out.where(F.col("is_extended") == is_extended)
    return out


def page_frames(frames: DataFrame, offset: int = 0, max_rows: int = 50_000) -> DataFrame:
    """One page in source order."""
    order = present(frames, ["source_file", "frame_index"])
    return frames.orderBy(*order).offset(max(0, offset)).limit(max(1, max_rows))


def page_after(frames: DataFrame, after: tuple | None = None, max_rows: int = 50_000) -> DataFrame:
    """The page that follows a row in source order, told by its (source_file, frame_index), or by its frame_index alone in a table without
    files; None for the first page. Unlike an offset it skips files and row groups."""
    order = present(frames, ["source_file", "frame_index"])
    if after is not None:
        *file, number = after if isinstance(after, tuple) else (after,)
        if len(file) + 1 != len(order):
            raise ValueError(f"a page is continued after {order}")
        test = F.col("frame_index") > number
        if file:
            test = (F.col("source_file") > file[0]) | ((F.col("source_file") == file[0]) & test)
        frames = frames.where(test)
    return frames.orderBy(*order).limit(max(1, max_rows))


def message_window(frames: DataFrame, samples: DataFrame, *, only_decoded: bool = False, search: str | None = None,
                   page: int | None = None, page_rows: int = 50_000) -> DataFrame:
    """Frames with the name of their decoded message, or their id where nothing was decoded."""
    keys = [c for c in ["source_file", "frame_index"] if c in frames.columns and c in samples.columns]
    # min() keeps one name per frame and combines before the shuffle; all samples of a frame share it.
    named = samples.groupBy(*keys).agg(F.min("message_name").alias("decoded_name"))
    rows = same_keys_join(frames, named, keys, "left").withColumns({
        "is_decoded": F.col("decoded_name").isNotNull(),
        "id_hex": id_hex(F.col("can_id")),
        "data_hex": data_hex(F.col("payload")),
    }).withColumn("message_name", F.coalesce("decoded_name", "id_hex")).drop("decoded_name")
    if only_decoded:
        rows = rows.where("is_decoded")
    if search and search.strip():
        number, text = parse_id_literal(search), search.strip()
        rows = rows.where(F.col("can_id") == number if number is not None else (
            contains_text(F.col("id_hex"), text) | contains_text(F.col("message_name"), text)
            | contains_text(F.col("data_hex"), text)))
    if page is None:
        return rows
    size = max(page_rows, 1)
    return page_frames(rows, (max(1, page) - 1) * size, size)


def distinct_channels(frames: DataFrame) -> DataFrame:
    return frames.select("channel").distinct().orderBy("channel")


def signal_catalog(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Every signal with its number of samples."""
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))


def signal_watch(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per signal: updates, value range, and the latest value with its raw text, unit, time and frame."""
    carried = present(samples, ["value", "raw_value", "raw_hex", "unit"])
    last = F.max(F.struct("ts_ns", "frame_index", *carried)).alias("last")
    rows = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("updates"), F.min("value").alias("minimum"), F.max("value").alias("maximum"), last)
    return rows.select(*keys, "updates", "minimum", "maximum", F.col("last.ts_ns").alias("last_ts_ns"),
                       F.col("last.frame_index").alias("last_frame_index"),
                       *[F.col(f"last.{c}").alias(f"last_{c}" if c != "unit" else "unit") for c in carried])


def watch_order(watch: DataFrame) -> DataFrame:
    return watch.orderBy(*present(watch, ["message_name", "signal_name", "channel", "frame_id"]))


def search_watch(watch: DataFrame, text: str | None) -> DataFrame:
    """Rows whose names, id, channel or unit contain the text."""
    if not text or not text.strip():
        return watch
    t = text.strip()
    hits = [contains_text(F.col(c), t) for c in present(watch, ["signal_name", "message_name", "channel", "unit"])]
    if "frame_id" in watch.columns:
        hits.append(contains_text(id_hex(F.col("frame_id")), t))
    test = hits[0]
    for h in hits[1:]:
        test = test | F.coalesce(h, F.lit(False))
    return watch.where(test)


def frame_id_filter(samples: DataFrame, text: str | None) -> DataFrame:
    """Samples of one frame id; a text that is no id, or none, keeps all."""
    number = parse_id_literal(text) if text else None
    return samples if number is None else samples.where(F.col("frame_id") == number)


def search_signals(catalog: DataFrame, label: Column, text: str | None) -> DataFrame:
    if not text or not text.strip():
        return catalog
    return catalog.where(contains_text(label, text.strip()))
