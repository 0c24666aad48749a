import json

from pyspark.sql import functions as F

from buslens.operators.events import avg_decode_ms, ingest_events, normalize_events, recent_events, retain_recent, validate_events
from buslens.sinks.exports import export_ndjson
from buslens.streaming.events import start_ingest

GOOD = {"event_id": "e1", "event_name": "app_started", "timestamp_utc": "2024-05-01T10:00:00.1239Z", "installation_id": "i", "session_id": "s"}


def lines(spark, items):
    return spark.createDataFrame([(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)], "seq long, value string")


def test_error_codes(spark):
    cases = [
        (GOOD, None), ("{bad", "invalid_json"), ("[1]", "event_must_be_object"), ("null", "event_must_be_object"), ('"x"', "event_must_be_object"),
        ({**GOOD, "event_name": "other"}, "unknown_event_name"), ({**GOOD, "event_name": " app_started"}, "unknown_event_name"),
        ({**GOOD, "event_id": " "}, "missing_event_id"), ({**GOOD, "event_id": 5}, "missing_event_id"), ({**GOOD, "session_id": None}, "missing_session_id"),
        ({**GOOD, "timestamp_utc": "yesterday"}, "invalid_timestamp_utc"), ({**GOOD, "properties": {"x": "y" * 9000}}, "properties_too_large"),
        ({**GOOD, "properties": "y" * 40000}, "payload_too_large"), ({**GOOD, "properties": [1, 2]}, None)]
    got = [r["error"] for r in validate_events(lines(spark, [c for c, _ in cases])).orderBy("seq").collect()]
    assert got == [e for _, e in cases]


def test_normal_form(spark):
    event = {**GOOD, "event_id": " " + "x" * 100, "os_description": "o" * 200, "properties": {
        "a b": 1, "a.b": "t" * 200, "n": None, "f": 1.5, "yes": True, "list": [1, "x"], "obj": {"k": 1}, "": 3, "k" * 80: "long"}}
    r = normalize_events(validate_events(lines(spark, [event, {**GOOD, "properties": [1]}])), ["seq"]).orderBy("seq").collect()
    p = r[0]["properties"]
    assert len(r[0]["event_id"]) == 80 and len(r[0]["os_description"]) == 160
    assert p == {"a_b": "t" * 120, "n": None, "f": "1.5", "yes": "true", "list": "1,x", "obj": "[object Object]", "k" * 64: "long"}
    assert r[1]["properties"] == {} and r[1]["timestamp_utc"].microsecond == 123000
    assert json.loads(r[1]["event_json"])["timestamp_utc"] == "2024-05-01T10:00:00.123Z"


def test_first_of_an_id_wins_after_validation(spark):
    batch = lines(spark, [{**GOOD, "event_name": "nope"}, {**GOOD, "app_version": "first"}, {**GOOD, "app_version": "second"}, {**GOOD, "event_id": "e2"}])
    rows = {r["event_id"]: r["app_version"] for r in ingest_events(batch, ["seq"]).collect()}
    assert rows == {"e1": "first", "e2": ""}
    stored = spark.createDataFrame([("e1",)], "event_id string")
    assert [r["event_id"] for r in ingest_events(batch, ["seq"], stored).collect()] == ["e2"]


def test_retention_keeps_what_it_cannot_read(spark):
    items = [GOOD, {**GOOD, "timestamp_utc": "2020-01-01T00:00:00Z"}, "{bad", "", {**GOOD, "timestamp_utc": "?"}]
    now = F.lit("2024-05-20 00:00:00").cast("timestamp")
    assert [r["seq"] for r in retain_recent(lines(spark, items), now, days=30).orderBy("seq").collect()] == [0, 2, 3, 4]
    assert [r["seq"] for r in retain_recent(lines(spark, items), now, days=1).orderBy("seq").collect()] == [2, 3, 4]


def test_summary_and_export(spark, tmp_path):
    done = [{**GOOD, "event_id": f"d{i}", "event_name": "load_decode_completed", "properties": {"duration_ms": v}} for i, v in enumerate([100, 300, "x", None])]
    rows = ingest_events(lines(spark, done), ["seq"], received_at=F.timestamp_seconds("seq"))
    assert avg_decode_ms(rows).first()[0] == 200.0
    assert [r["event_id"] for r in recent_events(rows, 2).collect()] == ["d3", "d2"]
    export_ndjson(rows, str(tmp_path / "out"), after=F.timestamp_seconds(F.lit(0)), limit=2)
    back = [json.loads(r[0])["event_id"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert back == ["d1", "d2"]


def test_stream_restart_adds_nothing_twice(spark, tmp_path):
    drop, table, rejects, state = (str(tmp_path / n) for n in ("drop", "table", "rejects", "state"))
    lines(spark, [GOOD, {**GOOD, "app_version": "late"}, "{bad"]).coalesce(1).select("value").write.text(drop)
    start_ingest(spark, drop, table, rejects, state).awaitTermination()
    lines(spark, [GOOD, {**GOOD, "event_id": "e2"}]).coalesce(1).select("value").write.mode("append").text(drop)
    start_ingest(spark, drop, table, rejects, state).awaitTermination()
    start_ingest(spark, drop, table, rejects, str(tmp_path / "fresh")).awaitTermination()
    got = sorted((r["event_id"], r["app_version"]) for r in spark.read.parquet(table).collect())
    assert got == [("e1", ""), ("e2", "")]
    assert [r["error"] for r in spark.read.parquet(rejects).select("error").distinct().collect()] == ["invalid_json"]
