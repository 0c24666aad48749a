"""The signal catalog: bit layout, layout checks, and the form in which frames look it up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.bits import place_of
from buslens.functions.ids import DBC_EXTENDED_FLAG, EXTENDED_ID_MAX, j1939_pgn, normalize_dbc_id
from buslens.plans.staging import MAX_GROUP_ROWS
from buslens.schema import DBC_MESSAGES, DBC_SIGNALS


@dataclass(frozen=True)
class Catalog:
    """messages and signals as in schema.DBC_MESSAGES / DBC_SIGNALS, issues as import issues."""

    messages: DataFrame
    signals: DataFrame
    issues: DataFrame | None = None


def catalog_from_rows(spark, messages, signals) -> Catalog:
    """A catalog typed in by hand: message tuples and signal tuples in schema order."""
    return Catalog(spark.createDataFrame(messages, DBC_MESSAGES), spark.createDataFrame(signals, DBC_SIGNALS))


def with_message_ids(messages: DataFrame) -> DataFrame:
    """Add is_extended, the bus id and, for extended messages, the parameter group."""
    raw = F.col("raw_frame_id")
    ext = (raw.bitwiseAND(F.lit(DBC_EXTENDED_FLAG)) != 0) | (raw > EXTENDED_ID_MAX)
    return messages.withColumn("is_extended", ext).withColumn(
        "frame_id", normalize_dbc_id(raw, F.col("is_extended"))).withColumn(
        "pgn", F.when(F.col("is_extended"), j1939_pgn(F.col("frame_id"))))


def msb_position(start_bit: Column) -> Column:
    """Place of a bit when the payload is read byte by byte from the most significant bit down."""
    return F.floor(start_bit / 8).cast("int") * 8 + 7 - start_bit % 8


def occupied_bits(signals: DataFrame) -> DataFrame:
    """One row per signal and payload bit, bit 0 being the lowest bit of byte 0."""
    usable = signals.where((F.col("length") > 0) & (F.col("start_bit") >= 0))
    rows = usable.select("msg_order", "sig_order", "name", "start_bit", "little_endian", "is_mux", "mux_ids", "mux_ranges",
                         F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("i"))
    walk = msb_position(F.col("start_bit")) + F.col("i")
    bit = F.when(F.col("little_endian"), F.col("start_bit") + F.col("i")).otherwise(msb_position(walk))
    return rows.withColumn("bit", bit).drop("start_bit", "i")


def _dealt(signals: DataFrame, max_task_bits: int) -> DataFrame:
    """Signals dealt to so many tasks that each holds about max_task_bits of their bits."""
    total = signals.agg(F.sum(F.greatest(F.col("length"), F.lit(0)).cast("long"))).first()[0] or 0
    tasks = -(-total // max_task_bits)
    return signals.repartition(tasks, "msg_order", "sig_order") if tasks > 1 else signals


def bit_layout(catalog: Catalog, bits: int = 64, *, max_task_bits: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per message and payload bit in use: the owning signal, or that several claim it."""
    label = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "(unnamed)").otherwise(F.col("name"))
    # A task sorts the bits of its signals before they are combined.
    used = occupied_bits(_dealt(catalog.signals, max_task_bits)).where(F.col("bit").between(0, bits - 1))
    return used.groupBy("msg_order", "bit").agg(
        F.count(F.lit(1)).alias("claims"), F.min_by(label, F.col("sig_order")).alias("first_owner"),
    ).select("msg_order", "bit", F.when(F.col("claims") > 1, "OVERLAP").otherwise(F.col("first_owner")).alias("owner"),
             (F.col("claims") > 1).alias("is_overlap"))


def dbc_conflicts(catalog: Catalog, bits: int = 64) -> DataFrame:
    """Per message: doubly claimed bits, bits beyond its length, bits beyond the payload, unnamed signals, shared id."""
    window = F.least(F.greatest(F.col("dlc"), F.lit(0)), F.lit(bits // 8)) * 8
    inside = F.col("bit").between(0, bits - 1)
    per_bit = (occupied_bits(catalog.signals).groupBy("msg_order", "bit").agg(F.count(F.lit(1)).alias("claims"))
               .join(catalog.messages.select("msg_order", "dlc"), "msg_order")
               .groupBy("msg_order").agg(
                   F.sum(F.when(inside, F.col("claims") - 1).otherwise(0)).alias("overlap_bits"),
                   F.sum(F.when(inside & (F.col("bit") >= window), F.col("claims")).otherwise(0)).alias("bits_beyond_dlc"),
                   F.sum(F.when(~inside, F.col("claims")).otherwise(0)).alias("bits_beyond_payload")))
    unnamed = catalog.signals.groupBy("msg_order").agg(
        F.count_if(F.trim(F.coalesce("name", F.lit(""))) == "").alias("unnamed_signals"))
    messages = with_message_ids(catalog.messages)
    uses = messages.groupBy("is_extended", "frame_id").agg((F.count(F.lit(1)) > 1).alias("id_shared"))
    messages = messages.join(uses, ["is_extended", "frame_id"])
    zero = {c: 0 for c in ["overlap_bits", "bits_beyond_dlc", "bits_beyond_payload", "unnamed_signals"]}
    return (messages.join(per_bit, "msg_order", "left").join(unnamed, "msg_order", "left")
            .select("msg_order", "name", "is_extended", "frame_id", *zero, "id_shared").fillna(zero))


def _intervals() -> Column:
    """Multiplexer values for which a signal is present; empty means always."""
    ids = F.transform(F.filter(F.coalesce("mux_ids", F.array().cast("array<int>")), lambda x: x >= 0),
                      lambda x: F.struct(x.cast("long").alias("lo"), x.cast("long").alias("hi")))
    ranges = F.transform("mux_ranges", lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi")))
    return F.when(F.size(F.coalesce("mux_ranges", F.array().cast("array<struct<mux:string,lo:bigint,hi:bigint>>"))) > 0,
                  ranges).otherwise(ids)


def dbc_overlap(catalog: Catalog) -> DataFrame:
    """Signal pairs of a message that claim a common bit and can be present together."""
    bits = occupied_bits(catalog.signals).withColumn("spans", _intervals())
    left = bits.select("msg_order", "bit", F.col("sig_order").alias("left_order"), F.col("name").alias("left_name"),
                       F.col("is_mux").alias("left_mux"), F.col("spans").alias("left_spans"))
    right = bits.select("msg_order", "bit", F.col("sig_order").alias("right_order"), F.col("name").alias("right_name"),
                        F.col("is_mux").alias("right_mux"), F.col("spans").alias("right_spans"))
    meet = F.exists("left_spans", lambda a: F.exists("right_spans", lambda b: (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])))
    together = (F.col("left_mux") | F.col("right_mux") | (F.size("left_spans") == 0) | (F.size("right_spans") == 0) | meet)
    return (left.join(right, ["msg_order", "bit"]).where((F.col("left_order") < F.col("right_order")) & together)
            .groupBy("msg_order", "left_order", "left_name", "right_order", "right_name")
            .agg(F.count(F.lit(1)).alias("shared_bits")))


def highest_bit() -> Column:
    """Highest payload bit of a signal; a Motorola walk enters every further byte at its bit 7."""
    start, n = F.col("start_bit"), F.col("length")
    last_byte = F.floor((msb_position(start) + n - 1) / 8).cast("int")
    motorola = F.when(last_byte == F.floor(start / 8).cast("int"), start).otherwise(last_byte * 8 + 7)
    return F.when(F.col("little_endian"), start + n - 1).otherwise(motorola)


def layout_issues(catalog: Catalog) -> DataFrame:
    """Messages that must not be decoded, with the first reason found."""
    unusable = (F.col("length") < 0) | ((F.col("length") > 0) & (F.col("start_bit") < 0))
    bad = (catalog.signals.join(catalog.messages.select("msg_order", "dlc"), "msg_order")
           .select("msg_order", F.concat(F.lit("signal "), "name", F.when(unusable, " has no valid length").when(
               (F.col("length") > 0) & (highest_bit() >= F.col("dlc") * 8), " lies outside the payload")).alias("reason"), F.lit(0).alias("rank"))
           .where("reason is not null"))
    shared = dbc_overlap(catalog).select("msg_order", F.concat(
        F.lit("signals "), "left_name", F.lit(" and "), "right_name", F.lit(" share bits")).alias("reason"), F.lit(1).alias("rank"))
    return bad.unionByName(shared).groupBy("msg_order").agg(F.min(F.struct("rank", "reason"))["reason"].alias("reason"))


def layout_issue_rows(catalog: Catalog) -> DataFrame:
    """The suppressed messages as import issues."""
    named = layout_issues(catalog).join(with_message_ids(catalog.messages), "msg_order")
    return named.select(
        F.lit(None).cast("string").alias("source_file"), F.lit("Error").alias("severity"),
        F.lit("DBC_SIGNAL_LAYOUT").alias("code"), F.lit("catalog").alias("parser"), F.lit(0).cast("long").alias("source_line"),
        F.concat("name", F.lit(" (0x"), F.hex("frame_id"), F.lit(") is not decoded: "), "reason").alias("message"),
        F.lit("").alias("line_text"))


NO_IDS, NO_RANGES = "array<int>", "array<struct<mux:string,lo:bigint,hi:bigint>>"


def decodable_messages(catalog: Catalog) -> DataFrame:
    """One row per message with its signals as an array, multiplexers first.

    dynamic marks messages whose present signals depend on the payload or share a
    name; all others decode the whole array without looking at it again.
    """
    place = place_of(F.col("start_bit"), F.col("length"), F.col("little_endian"), msb_position(F.col("start_bit")), F.col("dlc"))
    sig = F.struct(
        (~F.col("is_mux")).alias("rank"), "sig_order", "name", "length", "is_signed", "scale", "offset", "unit", "is_mux",
        F.coalesce("mux_ids", F.array().cast(NO_IDS)).alias("mux_ids"), F.coalesce("mux_ranges", F.array().cast(NO_RANGES)).alias("mux_ranges"),
        "value_kind", *[c.alias(n) for n, c in place.items()],
        ((F.col("length") > 0) & (F.col("start_bit") >= 0) & (highest_bit() < F.col("dlc") * 8)).alias("inside"))
    messages = with_message_ids(catalog.messages)
    signals = catalog.signals.join(messages.select("msg_order", "dlc"), "msg_order").groupBy("msg_order").agg(
        F.sort_array(F.collect_list(sig)).alias("signals"),
        (F.countDistinct("name") < F.count(F.lit(1))).alias("same_names"))
    suppressed = layout_issues(catalog).select("msg_order", F.lit(True).alias("suppress"))
    rows = messages.join(signals, "msg_order", "left").join(suppressed, "msg_order", "left").withColumns({
        "signals": F.coalesce("signals", F.array().cast(signals.schema["signals"].dataType)),
        "suppress": F.coalesce("suppress", F.lit(False))})
    conditional = F.exists("signals", lambda s: (F.size(s["mux_ids"]) > 0) | (F.size(s["mux_ranges"]) > 0))
    return rows.withColumns({
        "dynamic": conditional | F.coalesce("same_names", F.lit(False)),
        "fits": F.forall("signals", lambda s: s["inside"]),
    }).drop("same_names")


MESSAGE_FIELDS = ["msg_order", "name", "dlc", "is_extended", "suppress", "dynamic", "fits", "signals"]


def exact_lookup(messages: DataFrame) -> DataFrame:
    """Per bus id: its messages in catalog order."""
    return messages.groupBy(F.col("is_extended").alias("key_ext"), F.col("frame_id").alias("key_id")).agg(
        F.sort_array(F.collect_list(F.struct(*MESSAGE_FIELDS))).alias("exact"))


def pgn_lookup(messages: DataFrame) -> DataFrame:
    """Per parameter group: how many messages share it, and the message if it is the only one."""
    return messages.where("pgn is not null").groupBy(F.col("pgn").alias("key_pgn")).agg(
        F.count(F.lit(1)).alias("pgn_messages"), F.collect_list(F.struct(*MESSAGE_FIELDS)).alias("by_pgn"),
    ).withColumn("by_pgn", F.when(F.col("pgn_messages") == 1, F.col("by_pgn")))
