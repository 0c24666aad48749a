"""Signal catalogs from DBC text files, read as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from buslens.functions.ids import DBC_EXTENDED_FLAG, normalize_dbc_id
from buslens.functions.time import trimmed
from buslens.operators.catalog import Catalog, layout_issue_rows, with_message_ids
from buslens.operators.ordered import ordered
from buslens.plans.staging import sized, staged
from buslens.schema import ISSUE_COLS
from buslens.sources.lines import groups, plain_lines

# Fixed line patterns.
# 1 id, 2 name, 3 length
MESSAGE = r"^BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s+.*$"
# 1 name, 2 multiplexer mark, 3 start, 4 length, 5 byte order, 6 sign, 7 scale, 8 offset, 9 minimum, 10 maximum, 11 unit
SIGNAL = (r'^\s*SG_\s+(\w+)(?:\s+(M|m\d+))?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s+\(([^,]+),([^)]+)\)\s+'
          r'\[([^|]+)\|([^\]]+)\]\s+"([^"]*)".*$')
# 1 message id, 2 signal, 3 kind
VALUE_TYPE = r"^SIG_VALTYPE_\s+(\d+)\s+(\w+)\s*:\s*(\d+)\s*;?.*$"
# 1 message id, 2 signal, 3 multiplexer, 4 ranges
MUX_RANGES = r"^.*?SG_MUL_VAL_\s+(\d+)\s+(\w+)\s+(\w+)\s+((?:\d+-\d+(?:,\s*)?)+)\s*;?.*$"
VALUE_KINDS = {"1": "IeeeFloat32", "2": "IeeeFloat64"}


def catalog_of(source_file: Column) -> Column:
    """Ids are known within one catalog: a file, or the folder that a catalog was written to in parts."""
    return F.when(source_file.rlike("/part-[^/]*$"), F.regexp_replace(source_file, "/[^/]*$", "")).otherwise(source_file)


def load_dbc(spark, path) -> Catalog:
    """Messages, signals, value types and extended multiplexing, with issues for what cannot be used."""
    lines = plain_lines(spark, path)
    place = ["source_file", "source_line"]
    text = F.col("line_text")
    m, s = groups(text, MESSAGE, 3), groups(text, SIGNAL, 11)
    # One pass in file order gives each line the message line above it, and counts messages and signals up to it.
    o = ordered(lines.withColumns({"is_message": m.isNotNull(), "is_signal": s.isNotNull()}), ["source_file"], ["source_line"])
    o = o.select(one=F.col("is_message").cast("long"), sig=F.col("is_signal").cast("long")).running_sum(message_no="one", signal_no="sig")
    o = o.select(here=F.when(F.col("is_message"), F.struct("source_line", "signal_no", m[0].cast("long").alias("raw_frame_id")))).last_known(above="here")
    rows = staged(o.done().select(
        *place, "line_text", "line", "is_message", "is_signal", "message_no", F.col("above.source_line").alias("message_line"),
        F.col("above.raw_frame_id").alias("raw_frame_id"), (F.col("signal_no") - F.col("above.signal_no") - 1).cast("int").alias("sig_order")), "dbc")
    rows = rows.withColumn("catalog", catalog_of(F.col("source_file")))

    # Messages are numbered over all files: per file, then by the messages of the files before.
    per_file = rows.where("is_message").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized(per_file.select("source_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off")))
    known = rows.where("message_line is not null").join(offsets, "source_file").withColumn(
        "msg_order", (F.col("message_no") - 1 + F.col("off")).cast("int"))
    messages = sized(known.where("is_message").withColumn("m", m).select(
        "msg_order", "raw_frame_id", F.col("m")[1].alias("name"), F.col("m")[2].cast("int").alias("dlc"), "catalog", *place))

    # Signals belong to the message line above them.
    defs = known.where("is_signal").withColumn("s", s)
    s = F.col("s")
    kinds = rows.withColumn("k", groups(text, VALUE_TYPE, 3)).where("k is not null").groupBy(
        "catalog", F.col("k")[0].cast("long").alias("raw_frame_id"), F.col("k")[1].alias("name")).agg(
        F.max_by(F.col("k")[2], F.struct(*place)).alias("kind"))
    kind = F.when(F.col("kind") == "1", VALUE_KINDS["1"]).when(F.col("kind") == "2", VALUE_KINDS["2"]).otherwise("Integer")
    has_id = s[1].startswith("m")
    mux_id = F.expr("substring(s[1], 2)").try_cast("int")
    unread_mux = defs.where(has_id & mux_id.isNull())
    signals = defs.where(~has_id | mux_id.isNotNull()).select(
        "catalog", "raw_frame_id", "msg_order", "sig_order", s[0].alias("name"), s[2].cast("int").alias("start_bit"),
        s[3].cast("int").alias("length"), (s[4] == "1").alias("little_endian"), (s[5] == "-").alias("is_signed"),
        *[trimmed(s[i]).try_cast("double").alias(n) for i, n in ((6, "scale"), (7, "offset"), (8, "minimum"), (9, "maximum"))],
        s[10].alias("unit"), (s[1] == "M").alias("is_mux"),
        F.when(has_id, F.array(mux_id)).otherwise(F.array().cast("array<int>")).alias("mux_ids"),
    ).join(sized(kinds), ["catalog", "raw_frame_id", "name"], "left").withColumn("value_kind", kind).drop("kind")

    # Only messages and signals that a range names are looked up.
    ranges = sized(_mux_ranges(rows.withColumn("x", groups(text, MUX_RANGES, 4)), place))
    first_message = with_message_ids(messages).join(ranges.select("catalog", "frame_id").distinct(), ["catalog", "frame_id"], "left_semi").groupBy(
        "catalog", "frame_id").agg(F.min("msg_order").alias("msg_order"))
    named = sized(ranges.select("catalog", "frame_id", "name").distinct().join(first_message, ["catalog", "frame_id"]))
    owner = signals.select("msg_order", "name", "sig_order").join(named, ["msg_order", "name"]).groupBy(
        "catalog", "frame_id", "name", "msg_order").agg(F.min("sig_order").alias("sig_order"))
    found = sized(ranges.join(owner, ["catalog", "frame_id", "name"], "left"))
    usable = sized(found.where("not bad_range and sig_order is not null").groupBy("msg_order", "sig_order").agg(
        F.max_by("mux_ranges", F.struct(*place)).alias("mux_ranges")))
    signals = signals.join(usable, ["msg_order", "sig_order"], "left").select(
        "msg_order", "sig_order", "name", "start_bit", "length", "little_endian", "is_signed", "scale", "offset", "minimum",
        "maximum", "unit", "is_mux", "mux_ids",
        F.coalesce("mux_ranges", F.array().cast("array<struct<mux:string,lo:bigint,hi:bigint>>")).alias("mux_ranges"), "value_kind")

    catalog = Catalog(messages.select("msg_order", "raw_frame_id", "name", "dlc"), sized(signals))
    issues = [_issue(found.where("bad_range or sig_order is null"), "DBC_EXT_MUX", F.when(
        F.col("bad_range"), "multiplexer range is reversed").otherwise("multiplexed signal or its message is missing"))]
    unread = rows.where((F.col("line").rlike(r"^BO_\s") & ~F.col("is_message")) | (F.col("line").rlike(r"^SG_\s") & ~F.col("is_signal")))
    issues.append(_issue(unread, "DBC_PARSE", F.lit("definition cannot be read")))
    issues.append(_issue(unread_mux, "DBC_PARSE", F.lit("multiplexer id is out of range")))
    none = rows.groupBy("source_file").agg(F.lit(0).cast("long").alias("source_line"), F.lit("").alias("line_text")).join(
        offsets, "source_file", "left_anti")
    issues.append(_issue(none, "DBC_NO_MESSAGES", F.lit("catalog has no usable messages")))
    issues.append(layout_issue_rows(catalog).select(*ISSUE_COLS))
    every = issues[0]
    for more in issues[1:]:
        every = every.unionByName(more)
    return Catalog(catalog.messages, catalog.signals, sized(every))


def _mux_ranges(rows: DataFrame, place: list[str]) -> DataFrame:
    x = F.col("x")
    raw = x[0].cast("long")
    ext = raw.bitwiseAND(F.lit(DBC_EXTENDED_FLAG)) != 0
    spans = F.transform(F.filter(F.split(x[3], ","), lambda r: F.trim(r) != ""), lambda r: F.struct(
        x[2].alias("mux"), F.split(F.trim(r), "-")[0].cast("long").alias("lo"), F.split(F.trim(r), "-")[1].cast("long").alias("hi")))
    return rows.where("x is not null").select(
        "catalog", *place, "line_text", normalize_dbc_id(raw, ext).alias("frame_id"), x[1].alias("name"), spans.alias("mux_ranges"),
    ).withColumn("bad_range", F.exists("mux_ranges", lambda r: r["hi"] < r["lo"]))


def _issue(rows: DataFrame, code: str, message) -> DataFrame:
    return rows.select("source_file", F.lit("Error").alias("severity"), F.lit(code).alias("code"), F.lit("catalog").alias("parser"),
                       "source_line", message.alias("message"), "line_text").select(*ISSUE_COLS)
