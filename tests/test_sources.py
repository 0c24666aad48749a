import pytest
from pyspark.sql import functions as F

from buslens.functions.time import ts_css_ns, ts_millis_ns, ts_seconds_ns, ts_tod_ns
from buslens.functions.ids import byte_token, hex_id, parse_id, payload_from_hex, payload_from_pairs
from buslens.functions.frame import with_frame_checks, with_frame_projections
from buslens.plans.dataset import IntegrityError, integrity_gate
from buslens.sources.detect import detect_format
from buslens.sources.readers import read_log


def rows(log):
    return [r.asDict() for r in log.frames.orderBy("frame_index").collect()]


def codes(log):
    return sorted((r["source_line"], r["code"]) for r in log.issues.collect())


def accounted(log):
    for r in log.report.collect():
        assert r["total"] == r["non_data"] + r["accepted"] + r["rejected"]
    return log.report.first()


def test_exact_timestamps(spark):
    texts = ["0", "1.000000001", "864000.123456789", "1,5", "1.0000000001", "1.10000000000", "bad", "", ".5", "-2.5", "1e3", "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(ts_seconds_ns(F.col("t"))).collect()]
    assert got == [0, 1_000_000_001, 864_000_123_456_789, 1_500_000_000, None, 1_100_000_000, None, None, 500_000_000, -2_500_000_000, None, None]
    ms = spark.createDataFrame([("1234.000001",), ("1,0000001",), ("7",)], "t string")
    assert [r[0] for r in ms.select(ts_millis_ns(F.col("t"))).collect()] == [1_234_000_001, None, 7_000_000]
    tod = spark.createDataFrame([("23:59:59:999999999",), ("1:2:3:4",), ("25:00:00:0",), ("00:60:00:0",), ("00:00:60:0",), ("bad",)], "t string")
    assert [r[0] for r in tod.select(ts_tod_ns(F.col("t"))).collect()] == [86_399_999_999_999, 3_723_400_000_000, None, None, None, None]
    css = spark.createDataFrame([("01T000000001",), ("02T010203004",), ("00T000000000",), ("01T250000000",)], "t string")
    assert [r[0] for r in css.select(ts_css_ns(F.col("t"))).collect()] == [1_000_000, 90_123_004_000_000, None, None]


def test_ids_and_payloads(spark):
    df = spark.createDataFrame([(t,) for t in ["0x10", "1A", "10", "FFFFFFFF", "1FFFFFFFF", "4294967296", "x", "", " 7 "]], "t string")
    assert [r[0] for r in df.select(parse_id(F.col("t"))).collect()] == [16, 26, 10, 0xFFFFFFFF, None, None, None, None, 7]
    df = spark.createDataFrame([("00000000012",), ("123456789",), ("g",)], "t string")
    assert [r[0] for r in df.select(hex_id(F.col("t"))).collect()] == [18, None, None]
    df = spark.createDataFrame([("0xAB01",), ("abc",), ("zz",), ("",)], "t string")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in df.select(payload_from_hex(F.col("t"))).collect()] == [b"\xab\x01", None, None, b""]
    df = spark.createDataFrame([("01 02  ff",), ("0102",), ("1 2",), ("",)], "t string")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in df.select(payload_from_pairs(F.col("t"))).collect()] == [b"\x01\x02\xff", None, None, b""]
    df = spark.createDataFrame([("0xA",), ("bb",), ("123",), ("0x",)], "t string")
    assert [r[0] for r in df.select(byte_token(F.col("t"))).collect()] == ["0A", "bb", None, None]


def test_frame_checks(spark):
    cases = [  # id, ext, declared, payload, fd -> ok, code
        (0x7FF, False, 8, 8, False, True, 8), (0x800, False, 8, 8, False, False, None), (0x1FFFFFFF, True, 0, 0, False, True, 0),
        (0x20000000, True, 0, 0, False, False, None), (1, False, 7, 8, False, False, None), (1, False, 9, 12, True, True, 9),
        (1, False, 12, 12, True, True, 9), (1, False, 15, 64, True, True, 15), (1, False, 64, 64, True, True, 15),
        (1, False, 13, 13, True, False, None), (1, False, 10, 12, True, False, None), (1, False, 65, 65, True, False, None), (1, False, 8, 8, True, True, 8)]
    df = spark.createDataFrame(cases, "can_id long, is_extended boolean, declared int, payload_len int, fd_marker boolean, ok boolean, code int")
    for r in with_frame_checks(df).collect():
        assert (r["frame_error"] is None) == r["ok"], r
        if r["ok"]:
            assert r["dlc"] == r["code"]


def test_candump_flags_comments_and_rejects(spark, text_file):
    path = text_file("a.log", [
        "(10.000000001) can0 123#DEADBEEF", "# comment", "(10.5) can1 18FF5000##3001122334455667788990011", "(11) can0 123#ABC",
        "(12.0000000001) can0 1#", "bad", "", "(13.5) can0 7FF#", "(14) can0 1##", "(15) can0 1#R"])
    log = read_log(spark, path, "candump")
    got = rows(log)
    assert [r["ts_ns"] for r in got] == [0, 499_999_999, 3_499_999_999]
    assert [r["source_line"] for r in got] == [1, 3, 8]
    assert [r["frame_index"] for r in got] == [0, 1, 2]
    assert got[1]["brs"] and got[1]["esi"] and got[1]["frame_format"] == "FlexibleDataRate" and got[1]["dlc"] == 9 and got[1]["payload_len"] == 12
    assert codes(log) == [(4, "CANDUMP_VALUE"), (5, "CANDUMP_VALUE"), (6, "CANDUMP_SYNTAX"), (9, "CANDUMP_VALUE"), (10, "CANDUMP_SYNTAX")]
    account = accounted(log)
    assert (account["total"], account["non_data"], account["accepted"], account["completeness"]) == (10, 2, 3, "Partial")


def test_base_time_comes_from_a_rejected_line(spark, text_file):
    log = read_log(spark, text_file("b.log", ["(5) can0 1#ABC", "(7) can0 1#AB"]), "candump")
    assert [r["ts_ns"] for r in rows(log)] == [2_000_000_000]


def test_busmaster_midnight_and_backwards(spark, text_file):
    path = text_file("c.log", [
        "*** header", "23:59:59:999999999 Rx 1 0x123 s 2 01 02", "00:00:00:000000001 Tx 1 18FF5000 x 1 AA", "00:00:00:000000000 Tx 1 100 s 1 AA",
        "25:00:00:0 Rx 1 1 s 0", "00:00:01:5 Rx 1 100 s 3 AA BB", "00:00:02:5 Rx 1 100 fd 9 00 01 02 03 04 05 06 07 08 09 0A 0B", "nothing"])
    log = read_log(spark, path, "busmaster")
    got = rows(log)
    assert [r["ts_ns"] for r in got] == [0, 2, 1, 2_500_000_001]
    assert [r["is_extended"] for r in got] == [False, True, False, False]
    assert [r["direction"] for r in got] == ["Receive", "Transmit", "Transmit", "Receive"]
    assert codes(log) == [(4, "TIME_BACKWARDS"), (5, "BUSMASTER_VALUE"), (6, "BUSMASTER_VALUE"), (8, "BUSMASTER_SYNTAX")]
    # A warning alone blocks nothing.
    assert not integrity_gate(log.issues.where("severity = 'Warning'"), "Strict", "x")


def test_peak_layouts_and_ext_rule(spark, text_file):
    path = text_file("d.trc", [
        ";$FILEVERSION=2.1", "1.5\t2\tx\t18FF50E5\t9\t00 01 02 03 04 05 06 07 08 09 0A 0B\tRx FD x", "   1)   1234.000001 Rx 123 2 01 02",
        "2) 1,0000001 Rx 123 1 01", "nope", "@ note"])
    log = read_log(spark, path, "peak")
    got = rows(log)
    assert [(r["ts_ns"], r["is_extended"], r["dlc"], r["channel"], r["frame_type"]) for r in got] == [(1_500_000, True, 9, "2", "Rx"), (1_234_000_001, False, 2, "", "Rx")]
    assert codes(log) == [(4, "PEAK_VALUE"), (5, "PEAK_SYNTAX")]
    from buslens.sources.peak import read_peak_trc
    assert [r["is_extended"] for r in rows(read_peak_trc(spark, path, ext_rule="literal"))] == [True, True]


def test_css_header_and_rejects(spark, text_file):
    path = text_file("e.txt", [
        "01T000000050;0;123;AABB", "Timestamp;Type;ID;Data", "01T000000100;0;123;0102", "01T000000200;1;18FF5000;0x0102030405060708",
        "01T000000300;4;1;00", "01T000000400;0;1;ABC", "01T000000500;1", "timestamp; type; id ;data", "01T000000600;2;7;" + "00" * 12])
    log = read_log(spark, path, "css")
    assert [(r["ts_ns"], r["frame_index"], r["source_line"], r["frame_type"], r["frame_format"]) for r in rows(log)] == [
        (0, 0, 3, "Std", "Classic"), (100_000_000, 1, 4, "Ext", "Classic"), (500_000_000, 2, 9, "Std", "FlexibleDataRate")]
    assert codes(log) == [(5, "CSS_VALUE"), (6, "CSS_VALUE"), (7, "CSS_COLUMNS")]
    assert accounted(log)["non_data"] == 3


def test_generic_is_tolerant_but_exact(spark, text_file):
    path = text_file("f.txt", ["# c", "foo 1.5 Rx 123 2 AA 0xB", "0.5 1AB x 0", "x y", "1.0 Tx 100 3 01 02", "7 tx"])
    log = read_log(spark, path, "generic")
    assert [(r["ts_ns"], r["can_id"], bytes(r["payload"]), r["frame_type"]) for r in rows(log)] == [
        (1_500_000_000, 123, b"\xaa\x0b", "Rx"), (500_000_000, 0x1AB, b"", ""), (1_000_000_000, 100, b"\x02", "Tx")]
    assert codes(log) == [(4, "GENERIC_SYNTAX"), (6, "GENERIC_SYNTAX")]


def test_detection(spark, text_file):
    text_file("a.log", ["(1.0) can0 123#00"])
    text_file("b.txt", ["nothing here"])
    text_file("c.trc", ["1) 1.0 Rx 123 1 00"])
    folder = text_file("d.txt", ["Timestamp;Type;ID;Data", "01T000000100;0;1;00"]).rsplit("/", 1)[0]
    found = {r["source_file"].rsplit("/", 1)[1]: (r["status"], r["format"]) for r in detect_format(spark, folder).collect()}
    assert found == {"a.log": ("ok", "candump"), "b.txt": ("unknown", None), "c.trc": ("ok", "peak"), "d.txt": ("ok", "css")}
    with pytest.raises(ValueError):
        read_log(spark, folder)
    tie = text_file("x.log", ["(1.0) can0 123#00", "23:59:59:9 Rx 1 1 s 0", "23:59:59:9 Rx 1 1 s 0"])
    # 20 for one candump line; 10 for the name and 30 for two others.
    assert detect_format(spark, tie).first()["format"] == "busmaster"


@pytest.mark.parametrize("split", [200, 1 << 27])
def test_numbers_do_not_depend_on_splits(spark, tmp_path, split):
    lines = [f"({i}.5) can0 {i % 2047:X}#{i:04X}" if i % 7 else "junk" for i in range(1, 400)]
    clock = [f"{(i * 3) % 24:02d}:00:00:{i:03d} Rx 1 10 s 1 0{i % 9}" if i % 5 else "junk" for i in range(1, 120)]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for n in ("x", "y"):
        (tmp_path / "a" / n).write_text("\n".join(lines) + "\n")
        (tmp_path / "b" / n).write_text("\n".join(clock) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        frames = read_log(spark, str(tmp_path / "a"), "candump").frames
        got = [tuple(r) for r in frames.orderBy("source_file", "frame_index").select("frame_index", "source_line", "can_id").collect()]
        clocked = read_log(spark, str(tmp_path / "b"), "busmaster").frames
        days = [tuple(r) for r in clocked.orderBy("source_file", "frame_index").select("frame_index", "source_line", "ts_ns").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [(n, i, i % 2047) for n, i in enumerate(i for i in range(1, 400) if i % 7)]
    assert got == want * 2
    hour, expected, day, prev, base = 3_600_000_000_000, [], 0, None, None
    for i in range(1, 120):
        if i % 5:
            t = (i * 3) % 24 * hour + i * 1_000_000
            day += prev is not None and prev - t > 12 * hour
            prev = t
            base = t if base is None else base
            expected.append((len(expected), i, day * 24 * hour + t - base))
    assert days == expected * 2


def test_strict_gate_raises_and_partial_does_not(spark, text_file):
    log = read_log(spark, text_file("g.log", ["(1) can0 1#00", "bad"]), "candump")
    with pytest.raises(IntegrityError):
        integrity_gate(log.issues, "Strict", "log")
    assert integrity_gate(log.issues, "Partial", "log")


def test_projections(spark, text_file):
    log = read_log(spark, text_file("h.log", ["(1) can0 1AB#41FF7A", "(2) can0 1#"]), "candump")
    a, b = with_frame_projections(log.frames).orderBy("frame_index").collect()
    assert (a["id_hex"], a["data_hex"], a["data_ascii"], a["message_type"]) == ("0x1AB", "41 FF 7A", "A.z", "CAN/Std")
    assert (b["data_hex"], b["data_ascii"]) == ("", "")
