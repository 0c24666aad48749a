import random
import struct

import pytest
from pyspark.sql import functions as F

from buslens.operators.catalog import bit_layout, catalog_from_rows, dbc_conflicts, dbc_overlap, layout_issues
from buslens.operators.decode import decode, decode_diagnostics, message_summary
from buslens.plans.dataset import IntegrityError, dataset_overview, load_dataset, signal_labels, with_provenance
from buslens.sinks.exports import export_decoded
from buslens.sources.dbc import load_dbc

EXT = 0x80000000


def sig(m, n, name, start, length, intel=True, signed=False, scale=1.0, offset=0.0, mux=False, ids=(), ranges=(), kind="Integer"):
    return (m, n, name, start, length, intel, signed, scale, offset, 0.0, 0.0, "u", mux, list(ids), list(ranges), kind)


def frames_of(spark, items):
    """items: (can_id, payload[, channel])"""
    rows = [(i, i + 1, i * 1000, x[0], x[0] > 0x7FF, len(x[1]), bytearray(x[1]), len(x[1]), "", "c0", "Classic") for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "frame_index long, source_line long, ts_ns long, can_id long, is_extended boolean, dlc int, payload binary, "
                                       "payload_len int, frame_type string, channel string, frame_format string")


def values(out):
    return {(r["frame_index"], r["signal_name"]): (r["value"], r["raw_value"], r["raw_hex"]) for r in out.samples.collect()}


def status(out):
    return [r["decode_status"] for r in out.frames.orderBy("frame_index").collect()]


def test_exact_values(spark):
    cat = catalog_from_rows(spark, [(0, 1, "U", 8), (1, 2, "M", 8), (2, 3, "F", 8), (3, 4, "G", 4)], [
        sig(0, 0, "u64", 0, 64), sig(1, 0, "mot", 7, 16, intel=False), sig(1, 1, "neg", 16, 8, signed=True), sig(1, 2, "scaled", 24, 8, scale=0.5, offset=-10.0),
        sig(2, 0, "f64", 0, 64, kind="IeeeFloat64"), sig(3, 0, "f32", 0, 32, kind="IeeeFloat32")])
    out = decode(frames_of(spark, [
        (1, (0xF123456789ABCDEF).to_bytes(8, "little")), (2, bytes([0x12, 0x34, 0xFF, 30, 0, 0, 0, 0])), (3, struct.pack("<d", 1.25)),
        (4, struct.pack("<f", float("nan"))), (4, struct.pack("<f", -2.5)), (3, struct.pack("<d", 5e-324)), (3, struct.pack("<d", -1.7976931348623157e308)),
        (3, struct.pack("<d", float("inf"))), (2, b"\0" * 7)]), cat)
    got = values(out)
    assert got[0, "u64"] == (17375808098319191535.0, 17375808098319191535, "0xF123456789ABCDEF")
    assert got[1, "mot"][:2] == (0x1234, 0x1234) and got[1, "neg"][:2] == (-1.0, 255) and got[1, "scaled"][0] == 5.0
    assert got[2, "f64"][0] == 1.25 and got[4, "f32"][0] == -2.5 and got[5, "f64"][0] == 5e-324 and got[6, "f64"][0] == -1.7976931348623157e308
    assert (3, "f32") not in got and (7, "f64") not in got
    # A frame whose values are no numbers is still a decoded frame; a wrong length is an error.
    assert status(out) == ["decoded"] * 8 + ["error"]
    assert {(r["message_name"], r["frames"]) for r in message_summary(out.frames).collect()} == {("U", 1), ("M", 1), ("F", 4), ("G", 2)}


@pytest.mark.parametrize("size", [8, 64])
def test_random_fields_against_integers(spark, size):
    """Every field alone in its message, so that no layout rule interferes."""
    rnd = random.Random(size)
    messages, signals, wanted, items = [], [], [], []
    for m in range(60):
        intel, bits = rnd.random() < 0.5, size * 8
        length = rnd.randint(1, min(bits, 126 if size > 8 else 64))
        signed = rnd.random() < 0.5
        pos = rnd.randint(0, bits - length)
        start = pos if intel else pos // 8 * 8 + 7 - pos % 8
        messages.append((m, m + 1, f"M{m}", size))
        signals.append(sig(m, 0, "s", start, length, intel, signed))
        data = rnd.randbytes(size) if m % 5 else b"\xff" * size
        number = int.from_bytes(data, "little") >> pos if intel else int.from_bytes(data, "big") >> (bits - pos - length)
        raw = number & ((1 << length) - 1)
        value = raw - (1 << length) if signed and raw >> (length - 1) else raw
        items.append((m + 1, data))
        wanted.append((float(value), raw, f"0x{raw:X}"))
    out = values(decode(frames_of(spark, items), catalog_from_rows(spark, messages, signals)))
    for i, want in enumerate(wanted):
        got = out[i, "s"]
        assert (got[0], int(got[1]), got[2]) == want, (signals[i], items[i])


def test_multiplexing_on_raw_values(spark):
    cat = catalog_from_rows(spark, [(0, 1, "M", 8)], [
        sig(0, 0, "mux", 0, 8, mux=True, scale=10.0), sig(0, 1, "same", 8, 8, ids=[1]), sig(0, 2, "same", 16, 8, ids=[2]),
        sig(0, 3, "ranged", 24, 8, ranges=[("mux", 2, 5)]), sig(0, 4, "both", 32, 8, ids=[3], ranges=[("mux", 1, 2)]), sig(0, 5, "other", 40, 8, ranges=[("nope", 0, 9)])])
    out = decode(frames_of(spark, [(1, bytes([k, 11, 22, 33, 44, 55, 0, 0])) for k in (1, 2, 5, 9)]), cat)
    got = {k: v[0] for k, v in values(out).items()}
    assert got == {(0, "mux"): 10.0, (0, "same"): 11.0, (1, "mux"): 20.0, (1, "same"): 22.0, (1, "ranged"): 33.0, (2, "mux"): 50.0, (2, "ranged"): 33.0, (3, "mux"): 90.0}


def test_last_present_signal_of_a_name_wins(spark):
    cat = catalog_from_rows(spark, [(0, 1, "M", 2)], [sig(0, 0, "a", 0, 8), sig(0, 1, "a", 8, 8)])
    assert values(decode(frames_of(spark, [(1, b"\x01\x02")]), cat))[0, "a"][0] == 2.0


def test_all_signals_muxed_out_without_multiplexer_is_an_error(spark):
    cat = catalog_from_rows(spark, [(0, 1, "M", 1), (1, 2, "Empty", 1)], [sig(0, 0, "a", 0, 8, ids=[1])])
    out = decode(frames_of(spark, [(1, b"\x01"), (2, b"\x01")]), cat)
    assert status(out) == ["error", "decoded"] and out.samples.count() == 0


def test_group_fallback_and_ambiguity(spark):
    one = [(0, EXT | 0x18FF5000, "A", 1), (1, 5, "S", 1)]
    cat = catalog_from_rows(spark, one, [sig(0, 0, "x", 0, 8), sig(1, 0, "y", 0, 8)])
    ids = [0x18FF5000, 0x18FF5022, 0x18FF6000, 5, 6, 0x18FF5000]
    payload = [b"\1"] * 5 + [b"\1\2"]
    items = list(zip(ids, payload))
    out = decode(frames_of(spark, items), cat)
    # The last frame has an exact id but a wrong length: an error, no fallback.
    assert status(out) == ["decoded", "decoded", "unmatched", "decoded", "unmatched", "error"]
    both = catalog_from_rows(spark, [*one, (2, EXT | 0x18FF5001, "B", 1)], [sig(0, 0, "x", 0, 8), sig(2, 0, "x", 0, 8)])
    out = decode(frames_of(spark, items), both)
    assert status(out) == ["decoded", "ambiguous", "unmatched", "decoded", "unmatched", "error"]
    d = decode_diagnostics(out.frames, both, out.samples).first()
    assert (d["frames"], d["ambiguous_frames"], d["unmatched_ids"], d["error_frames"], d["ext_messages"]) == (6, 1, 2, 1, 2)
    assert d["frames"] == d["decoded_frames"] + d["unmatched_frames"] + d["error_frames"] + d["ambiguous_frames"]


def test_first_fitting_candidate_in_catalog_order(spark):
    cat = catalog_from_rows(spark, [(0, 1, "Long", 8), (1, 1, "First", 1), (2, 1, "Second", 1)], [sig(1, 0, "a", 0, 8), sig(2, 0, "b", 0, 8)])
    out = decode(frames_of(spark, [(1, b"\7")]), cat)
    assert [r["message_name"] for r in out.frames.collect()] == ["First"]


def test_layout_checks(spark):
    cat = catalog_from_rows(spark, [(0, 1, "Over", 1), (1, 2, "Mux", 2), (2, 3, "Out", 1), (3, 3, "Mixed", 2)], [
        sig(0, 0, "a", 0, 8), sig(0, 1, "b", 4, 4), sig(1, 0, "m", 0, 8, mux=True), sig(1, 1, "p", 8, 8, ids=[1]), sig(1, 2, "q", 8, 8, ids=[2]),
        sig(2, 0, "far", 4, 8), sig(3, 0, "mot", 7, 12, intel=False), sig(3, 1, "", 8, 4)])
    pairs = {(r["msg_order"], r["left_name"], r["right_name"], r["shared_bits"]) for r in dbc_overlap(cat).collect()}
    assert pairs == {(0, "a", "b", 4)}
    assert {r["msg_order"] for r in layout_issues(cat).collect()} == {0, 2}
    assert status(decode(frames_of(spark, [(1, b"\1"), (2, b"\1\2")]), cat)) == ["error", "decoded"]
    bits = {(r["msg_order"], r["bit"]): r["owner"] for r in bit_layout(cat).collect()}
    assert bits[0, 3] == "a" and bits[0, 5] == "OVERLAP" and bits[3, 12] == "mot" and bits[3, 8] == "(unnamed)"
    assert sorted(b for m, b in bits if m == 3) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
    c = {r["name"]: r for r in dbc_conflicts(cat).collect()}
    assert (c["Over"]["overlap_bits"], c["Mux"]["overlap_bits"], c["Out"]["bits_beyond_dlc"], c["Mixed"]["unnamed_signals"]) == (4, 8, 4, 1)
    assert c["Out"]["id_shared"] and not c["Over"]["id_shared"]


DBC = ['VERSION ""', "BO_ 291 Engine: 8 ECU", ' SG_ Speed : 0|16@1+ (0.1,0) [0|100] "km/h" X', ' SG_ Temp : 23|8@0- (1,-40) [-40|215] "C" X',
       "BO_ 2566868992 Group: 8 ECU", ' SG_ Sel M : 0|8@1+ (1,0) [0|0] "" X', ' SG_ P m1 : 8|8@1+ (1,0) [0|0] "" X', ' SG_ Q : 8|8@1+ (2,0) [0|0] "" X',
       ' SG_ Fl : 32|32@1- (1,0) [0|0] "" X', "SIG_VALTYPE_ 2566868992 Fl : 1;", "SG_MUL_VAL_ 2566868992 Q Sel 2-4, 7-7;"]


def test_catalog_text(spark, text_file):
    cat = load_dbc(spark, text_file("a.dbc", DBC))
    s = {r["name"]: r for r in cat.signals.collect()}
    assert (s["Speed"]["scale"], s["Temp"]["little_endian"], s["Temp"]["is_signed"], s["Temp"]["offset"], s["Speed"]["unit"]) == (0.1, False, True, -40.0, "km/h")
    assert s["Sel"]["is_mux"] and s["P"]["mux_ids"] == [1] and [tuple(r) for r in s["Q"]["mux_ranges"]] == [("Sel", 2, 4), ("Sel", 7, 7)]
    assert s["Fl"]["value_kind"] == "IeeeFloat32" and cat.issues.count() == 0
    out = decode(frames_of(spark, [(0x18FF5000, bytes([k, 5, 0, 0]) + struct.pack("<f", 1.5)) for k in (1, 3)]), cat)
    assert {k: v[0] for k, v in values(out).items()} == {(0, "Sel"): 1, (0, "P"): 5, (0, "Fl"): 1.5, (1, "Sel"): 3, (1, "Q"): 10, (1, "Fl"): 1.5}


def test_catalog_issues(spark, text_file):
    cat = load_dbc(spark, text_file("b.dbc", ["BO_ 1 A: 1 X", ' SG_ a : 0|8@1+ (1,0) [0|0] "" X', ' SG_ b : 4|4@1+ (1,0) [0|0] "" X', " SG_ broken",
                                                 "SG_MUL_VAL_ 1 gone a 1-2;", "SG_MUL_VAL_ 1 a a 5-2;"]))
    assert sorted(r["code"] for r in cat.issues.collect()) == ["DBC_EXT_MUX", "DBC_EXT_MUX", "DBC_PARSE", "DBC_SIGNAL_LAYOUT"]
    assert [r["code"] for r in load_dbc(spark, text_file("c.dbc", ["VERSION"])).issues.collect()] == ["DBC_NO_MESSAGES"]


def test_end_to_end(spark, text_file, tmp_path):
    log = text_file("run.log", ["(1.0) can0 123#2A00000000000000", "(2.0) can0 123#2B00000000000000"])
    dbc = text_file("a.dbc", DBC)
    data = load_dataset(spark, log, dbc)
    assert data.completeness == "Complete"
    got = sorted((r["signal_name"], r["ts_ns"], r["value"]) for r in data.samples.collect())
    assert got[:2] == [("Speed", 0, pytest.approx(4.2)), ("Speed", 1_000_000_000, pytest.approx(4.3))]
    p = with_provenance(data).first()
    assert len(p["source_log_sha256"]) == 64 and len(p["dbc_sha256"]) == 64 and p["import_mode"] == "Strict"
    o = dataset_overview(data).first()
    assert (o["frames"], o["samples"], o["signals"], o["messages"], list(o["channels"])) == (2, 4, 2, 1, ["can0"])
    assert [r["label"] for r in signal_labels(data.samples).collect()] == ["Engine.Speed [can0 | CAN | Std | 0x123]", "Engine.Temp [can0 | CAN | Std | 0x123]"]
    target = str(tmp_path / "csv")
    export_decoded(data.samples, data.frames, {"dataset_status": "COMPLETE", **p.asDict()}, target)
    back = spark.read.option("header", True).csv(target)
    assert len(back.columns) == 22
    row = back.where("signal_name = 'Speed' and frame_index = 1").first()
    assert (row["value"], row["raw_value"], row["dlc_code"], row["source_log_sha256"]) == (repr(43 * 0.1), "43", "8", p["source_log_sha256"])


def test_strict_and_partial_loads(spark, text_file):
    dbc = text_file("a.dbc", DBC)
    bad = text_file("bad.log", ["(1.0) can0 123#2A", "(2.0) can0 123#2B00000000000000", "junk"])
    with pytest.raises(IntegrityError):
        load_dataset(spark, bad, dbc, fmt="candump")
    data = load_dataset(spark, bad, dbc, mode="Partial", fmt="candump")
    assert {r["quality"] for r in data.samples.collect()} == {"PartialDataset"}
    assert sorted(r["code"] for r in data.issues.collect()) == ["CANDUMP_SYNTAX", "DECODE_ERROR"]
