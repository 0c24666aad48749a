"""Frames to physical signal values with the catalog.

The catalog is joined as a small lookup, so frames never shuffle: each frame
finds its message, its payload becomes 64-bit words once, and the signals of the
message are exploded and cut out with shift and mask expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions import bits
from buslens.functions.ids import STANDARD_ID_MAX, j1939_pgn, normalize_dbc_id
from buslens.operators.catalog import Catalog, decodable_messages, exact_lookup, pgn_lookup, with_message_ids
from buslens.plans.staging import keep_where, same_keys_join, sized
from buslens.schema import present

DECODED, UNMATCHED, AMBIGUOUS, ERROR = "decoded", "unmatched", "ambiguous", "error"


@dataclass(frozen=True)
class Decoded:
    """frames: every frame with decode_status and message_name; samples: one row per signal value."""

    frames: DataFrame
    samples: DataFrame


def _mux_values(message: Column) -> Column:
    """Raw values of the message's multiplexers; wider than 63 bits cannot match any condition."""
    def raw(s):
        return F.struct(s["name"].alias("name"), F.when(s["length"] < 64, bits.raw_low64(F.col("words"), s)).alias("raw"))
    return F.transform(F.filter(message["signals"], lambda s: s["is_mux"]), raw)


def _is_present(s: Column, mux: Column) -> Column:
    """Whether the multiplexers select the signal: plain ids match any of them, ranges a named one."""
    by_id = (F.size(s["mux_ids"]) == 0) | F.exists(
        mux, lambda v: F.coalesce(F.array_contains(s["mux_ids"], v["raw"].try_cast("int")), F.lit(False)))
    by_range = (F.size(s["mux_ranges"]) == 0) | F.exists(s["mux_ranges"], lambda r: F.exists(
        mux, lambda v: F.coalesce((v["name"] == r["mux"]) & v["raw"].between(r["lo"], r["hi"]), F.lit(False))))
    return s["is_mux"] | (by_id & by_range)


def _last_of_name(signals: Column) -> Column:
    """Of several present signals with one name the last one counts."""
    return F.filter(signals, lambda s, i: ~F.exists(
        F.slice(signals, i + 2, F.size(signals)), lambda later: later["name"] == s["name"]))


def match_messages(frames: DataFrame, messages: DataFrame, *, dynamic: bool = True) -> DataFrame:
    """Add decode_status, message_name, frame_id and present (the signals to read) to every frame.

    An exact id decides alone, even if its messages do not decode. Only extended
    frames without any exact message fall back to a parameter group with one message.
    """
    ext = F.col("is_extended") | (F.col("can_id") > STANDARD_ID_MAX)
    rows = frames.withColumn("key_ext", ext).withColumn("key_id", normalize_dbc_id(F.col("can_id"), F.col("key_ext")))
    rows = rows.join(exact_lookup(messages), ["key_ext", "key_id"], "left")
    rows = rows.withColumn("key_pgn", F.when(F.col("key_ext") & F.col("exact").isNull(), j1939_pgn(F.col("key_id"))))
    rows = rows.join(pgn_lookup(messages), "key_pgn", "left")
    rows = bits.with_words(rows, F.col("payload")).withColumn("candidates", F.coalesce("exact", "by_pgn"))
    # One step per column: each is used once by the next, so nothing is worked out twice.
    found = F.filter("candidates", lambda m: ~m["suppress"] & (m["is_extended"] == F.col("key_ext")) & (m["dlc"] == F.col("payload_len")))
    if dynamic:
        rows = rows.withColumn("found", F.transform(found, lambda m: F.struct(m.alias("m"), _mux_values(m).alias("mux"))))
        rows = rows.withColumn("found", F.transform("found", lambda x: F.struct(x["m"].alias("m"), F.filter(
            x["m"]["signals"], lambda s: _is_present(s, x["mux"])).alias("present"))))
        good = F.filter("found", lambda x: F.forall(x["present"], lambda s: s["inside"]) & (
            (F.size(x["present"]) > 0) | (F.size(x["m"]["signals"]) == 0)))
        rows = rows.withColumn("pick", F.get(good, F.lit(0))).withColumn("present", F.col("pick.present"))
        rows = rows.withColumn("present", _last_of_name(F.col("present")))
    else:
        usable = F.filter(found, lambda m: m["fits"])
        rows = rows.withColumn("pick", F.struct(F.get(usable, F.lit(0)).alias("m"))).withColumn("present", F.col("pick.m.signals"))
    name = F.col("pick.m.name")
    status = (F.when(name.isNotNull(), DECODED).when(F.col("candidates").isNotNull(), ERROR)
              .when(F.col("pgn_messages") > 1, AMBIGUOUS).otherwise(UNMATCHED))
    return rows.withColumns({"decode_status": status, "message_name": name, "frame_id": F.col("key_id"),
                             "is_extended_id": F.col("key_ext")}).drop(
        "key_ext", "key_id", "key_pgn", "exact", "by_pgn", "candidates", "pgn_messages", "found", "pick")


def _tame(factor: Column) -> Column:
    """A factor that keeps every integer reading finite."""
    return F.coalesce(F.abs(factor) < 1e100, F.lit(False))


@dataclass(frozen=True)
class Decoder:
    """A catalog made ready for decoding: the staged lookup, and which kinds of fields it holds."""

    messages: DataFrame
    dynamic: bool
    wide: bool
    ieee: bool
    wild: bool


def prepare(catalog: Catalog) -> Decoder:
    """Work out the lookup once; it serves any number of recordings."""
    messages = sized(decodable_messages(catalog))
    kinds = messages.agg(
        F.max("dynamic").alias("dynamic"),
        F.max(F.exists("signals", lambda s: s["length"] > 64)).alias("wide"),
        F.max(F.exists("signals", lambda s: s["value_kind"] != "Integer")).alias("ieee"),
        F.max(F.exists("signals", lambda s: ~_tame(s["scale"]) | ~_tame(s["offset"]))).alias("wild")).first()
    return Decoder(messages, *[bool(k) for k in kinds])


def decode(frames: DataFrame, catalog: Catalog | Decoder) -> Decoded:
    """What the catalog holds decides how much the expressions have to cover."""
    decoder = catalog if isinstance(catalog, Decoder) else prepare(catalog)
    matched = match_messages(frames, decoder.messages, dynamic=decoder.dynamic)
    carried = present(matched, ["source_file", "ts_ns", "frame_index", "source_line", "channel", "frame_format"])
    sizes = [F.col(c).alias(n) for c, n in (("dlc", "dlc_code"), ("payload_len", "payload_length")) if c in frames.columns]
    sig = F.col("sig")
    # The outer form, filtered afterwards, keeps the optimizer from testing the array expression below as well.
    rows = matched.select(*carried, F.col("is_extended_id").alias("is_extended"), "frame_id", "message_name", "words", *sizes,
                          F.explode_outer("present").alias("sig")).where(sig.isNotNull())
    new = {"word": bits.raw_low64(F.col("words"), sig)}
    if decoder.wide:
        new["pieces"] = F.when(sig["length"] > 64, bits.raw_pieces(F.col("words"), sig))
    pieces = F.col("pieces") if decoder.wide else None
    rows = rows.withColumns(new).drop("words")
    samples = rows.select(
        *carried, "is_extended", "frame_id", "message_name", sig["name"].alias("signal_name"),
        bits.physical_value(F.col("word"), pieces, sig, ieee=decoder.ieee).alias("value"),
        bits.exact_raw(F.col("word"), pieces).alias("raw_value"), bits.hex_text(F.col("word"), pieces).alias("raw_hex"),
        sig["unit"].alias("unit"), sig["sig_order"].alias("sig_order"), F.lit("Valid").alias("quality"),
        *present(rows, ["dlc_code", "payload_length"]))
    if decoder.ieee or decoder.wild:
        # Only such catalogs can yield values that are no finite number.
        samples = keep_where(samples, ~F.isnan("value") & (F.abs("value") < float("inf")))
    return Decoded(matched.drop("words", "present"), samples)


def message_summary(decoded_frames: DataFrame) -> DataFrame:
    """Decoded frames per message, also for messages without signals."""
    return (decoded_frames.where(F.col("decode_status") == DECODED).groupBy("frame_id", "message_name")
            .agg(F.count(F.lit(1)).alias("frames")).orderBy(F.desc("frames"), "frame_id", "message_name"))


def decode_diagnostics(decoded_frames: DataFrame, catalog: Catalog, samples: DataFrame | None = None) -> DataFrame:
    """One row of totals."""
    # Counting per id first keeps the distinct counts on a table of ids.
    per_id = decoded_frames.groupBy("can_id", "decode_status").agg(F.count(F.lit(1)).alias("n"))

    def total(status):
        return F.coalesce(F.sum(F.when(F.col("decode_status") == status, F.col("n"))), F.lit(0))

    def ids(status):
        return F.countDistinct(F.when(F.col("decode_status") == status, F.col("can_id")))

    out = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("frames"), F.countDistinct("can_id").alias("unique_ids"),
        total(DECODED).alias("decoded_frames"), total(UNMATCHED).alias("unmatched_frames"),
        ids(UNMATCHED).alias("unmatched_ids"), total(ERROR).alias("error_frames"), ids(ERROR).alias("error_ids"),
        total(AMBIGUOUS).alias("ambiguous_frames"), ids(AMBIGUOUS).alias("ambiguous_ids"))
    ext = with_message_ids(catalog.messages).agg(
        F.count(F.lit(1)).alias("dbc_messages"), F.count_if(~F.col("is_extended")).alias("std_messages"),
        F.count_if("is_extended").alias("ext_messages"))
    parts = [out, ext]
    if samples is not None:
        parts.append(samples.agg(F.count(F.lit(1)).alias("samples")))
    one = [p.withColumn("__one", F.lit(1)) for p in parts]
    joined = one[0]
    for p in one[1:]:
        joined = joined.join(p, "__one")
    return joined.drop("__one")


def _top_ids(decoded_frames: DataFrame, status: str, limit: int) -> DataFrame:
    return (decoded_frames.where(F.col("decode_status") == status).groupBy("can_id")
            .agg(F.count(F.lit(1)).alias("frames")).orderBy(F.desc("frames"), "can_id").limit(limit))


def top_unmatched(decoded_frames: DataFrame, catalog: Catalog, limit: int = 12) -> DataFrame:
    """Most frequent ids without a message, with their parameter group and all names known for the id."""
    ext = F.col("can_id") > STANDARD_ID_MAX
    rows = _top_ids(decoded_frames, UNMATCHED, limit).withColumn("is_extended", ext)
    rows = rows.withColumn("frame_id", normalize_dbc_id(F.col("can_id"), F.col("is_extended"))).withColumn(
        "pgn", F.when(F.col("is_extended"), j1939_pgn(F.col("frame_id"))))
    names = with_message_ids(catalog.messages).groupBy("is_extended", "frame_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("msg_order", "name"))), lambda m: m["name"]), ", ").alias("known_names"))
    return rows.join(names, ["is_extended", "frame_id"], "left").orderBy(F.desc("frames"), "can_id")


def top_decode_errors(decoded_frames: DataFrame, limit: int = 12) -> DataFrame:
    return _top_ids(decoded_frames, ERROR, limit)


def dbc_examples(catalog: Catalog, limit: int = 12) -> DataFrame:
    """First standard and extended messages by id."""
    rows = with_message_ids(catalog.messages)
    parts = [rows.where(F.col("is_extended") == e).orderBy("frame_id", "msg_order").limit(limit) for e in (False, True)]
    return parts[0].unionByName(parts[1]).select("is_extended", "name", "raw_frame_id", "frame_id", "pgn")


def unmatched_frames(decoded_frames: DataFrame) -> DataFrame:
    return decoded_frames.where(F.col("decode_status") == UNMATCHED)


def frame_samples(samples: DataFrame, frame_indexes: DataFrame) -> DataFrame:
    """Samples of the given frames, by message and signal."""
    keys = present(samples, [c for c in ["source_file", "frame_index"] if c in frame_indexes.columns])
    wanted = sized(frame_indexes.select(*keys).distinct())
    return same_keys_join(samples, wanted, keys).orderBy(*keys, "message_name", "signal_name")
