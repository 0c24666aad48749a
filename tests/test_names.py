"""Selections, suggestions, frame views and the driver contract."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from buslens.operators import frames as FR
from buslens.operators.suggest import suggest_signals
from buslens.sources.refs import load_signal_refs, resolve_refs

CATALOG = [("c0", "Classic", False, 1, "A", "x"), ("c1", "Classic", False, 1, "A", "x"), ("c0", "Classic", False, 2, "B", "y")]
SCHEMA = "channel string, frame_format string, is_extended boolean, frame_id long, message_name string, signal_name string"


def preset(tmp_path, name, **over):
    body = {"preset_type": "can-log-viewer-layout", "version": 1, "plot_groups": [{"title": "t", "signals": ["B.y [c0]"], "offsets": {"B.y [c0]": 2.5}}]}
    path = tmp_path / name
    path.write_text(json.dumps({**body, **over}))
    return str(path)


def test_selections(spark, tmp_path):
    cat = spark.createDataFrame(CATALOG, SCHEMA)
    got = resolve_refs(load_signal_refs(spark, preset(tmp_path, "a.json")), cat).first()
    assert (got["label"], got["offset"], got["matches"]) == ("B.y [c0 | CAN | Std | 0x2]", 2.5, 1)
    ident = {"channel": "c1", "frame_format": 0, "extended": False, "frame_id": 1, "message": "A", "signal": "x"}
    v2 = preset(tmp_path, "b.json", version=2, plot_groups=[{"title": "t", "signals": ["old"], "signal_identities": [ident], "offsets": {"old": 1}}])
    got = resolve_refs(load_signal_refs(spark, v2), cat).first()
    assert (got["label"], got["offset"]) == ("A.x [c1 | CAN | Std | 0x1]", 1.0)
    unclear = load_signal_refs(spark, preset(tmp_path, "c.json", plot_groups=[{"title": "t", "signals": ["A.x [?]", "Z.z"]}]))
    assert [(r["matches"], r["label"]) for r in resolve_refs(unclear, cat, strict=False).orderBy("ord").collect()] == [(2, None), (0, None)]
    for bad in (unclear, load_signal_refs(spark, preset(tmp_path, "d.json", version=3)), load_signal_refs(spark, preset(tmp_path, "e.json", preset_type="other"))):
        with pytest.raises(Exception, match="matches|version|type"):
            resolve_refs(bad, cat).collect()


def test_suggestions(spark):
    labels = ["Joy.pos_x", "Joy.pos_y", "Joy.yaw", "Act.LeftActualPos", "Act.RightPosition", "Act.RightForce", "Act.FrontFeedback", "Arm.cmd", "Arm.actual", "Zed.current"]
    got = {r["role"]: r["label"] for r in suggest_signals(spark.createDataFrame([(x,) for x in labels], "label string")).collect()}
    assert got == {"jx": "Joy.pos_x", "jy": "Joy.pos_y", "yaw": "Joy.yaw", "left": "Act.LeftActualPos", "right": "Act.RightPosition", "front": "Act.FrontFeedback",
                   "command": "Arm.cmd", "response": "Arm.actual"}


def test_frame_filters_and_pages(spark):
    rows = [(i, i * 1_000_000_000, i + 0x1F0, i % 2 == 1, bytearray([i, 0xAB]), "Rx" if i % 3 else "Tx", f"can{i % 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "frame_index long, ts_ns long, can_id long, is_extended boolean, payload binary, frame_type string, channel string")
    ids = lambda d: [r["frame_index"] for r in d.orderBy("frame_index").collect()]
    assert ids(FR.filter_frames(df, id_text=" 0x1f3 ")) == [3] and ids(FR.filter_frames(df, id_text="499")) == [3]
    assert ids(FR.filter_frames(df, id_text="x20")) == [16, 17, 18, 19]
    assert ids(FR.filter_frames(df, payload_hex="0x05 a")) == [5]
    assert ids(FR.filter_frames(df, time_start=5, time_end=7)) == [5, 6, 7]
    assert ids(FR.filter_frames(df, type_text="tx", channel_text="CAN1", is_extended=True)) == [3, 9, 15]
    assert ids(FR.page_frames(df, 5, 4)) == [5, 6, 7, 8] == ids(FR.page_after(df, 4, 4))
    assert FR.parse_id_literal("xyz") is None and FR.parse_id_literal("0x") is None


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.schema == entry.entry(spark).schema
