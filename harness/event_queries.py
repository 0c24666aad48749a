"""Usage events: checks, ingestion, summaries, and the continuous ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from buslens.operators import events as EV
from buslens.plans.staging import new_path
from buslens.sources.telemetry import load_telemetry
from buslens.streaming.events import start_ingest
from harness.registry import query, rounded
from harness.views import START_US, TELEMETRY, telemetry_lines


def stored(spark, d):
    """The ingested table; an event is received at its place in the recording."""
    received = F.timestamp_micros(F.lit(START_US) + F.col("seq") * 1_000_000)
    return EV.ingest_events(telemetry_lines(spark, d), ["seq"], received_at=received)


@query("validate_events", f"WITH {TELEMETRY} SELECT seq, error FROM tl")
def q_validate(spark, d):
    return EV.validate_events(telemetry_lines(spark, d)).select("seq", "error")


@query("rejected_events", f"WITH {TELEMETRY} SELECT error, count(*) AS lines FROM tl WHERE error IS NOT NULL GROUP BY 1")
def q_rejected(spark, d):
    return EV.rejected_events(telemetry_lines(spark, d)).groupBy("error").agg(F.count(F.lit(1)).alias("lines"))


@query("normalize_events", f"""WITH {TELEMETRY} SELECT seq, id AS event_id, event_name, 'i' || CAST(user_id AS VARCHAR) AS installation_id, 's' || CAST(seq AS VARCHAR) AS session_id, '2.0.2' AS app_version,
  '' AS os_description, CAST(round(value * 100) AS BIGINT) AS duration_ms, event_type AS kind, ts_ns // 1000000 AS time_ms FROM tl WHERE error IS NULL""")
def q_normalize(spark, d):
    rows = EV.normalize_events(EV.validate_events(telemetry_lines(spark, d)), ["seq"])
    p = F.col("properties")
    return rows.select("seq", "event_id", "event_name", "installation_id", "session_id", "app_version", "os_description", p["duration_ms"].cast("bigint").alias("duration_ms"),
                       p["kind_of"].alias("kind"), F.floor((F.unix_micros("timestamp_utc") - START_US) / 1000).alias("time_ms"))


@query("ingest_events", f"WITH {TELEMETRY} SELECT id AS event_id, seq, event_name FROM te")
def q_ingest(spark, d):
    return stored(spark, d).select("event_id", "seq", "event_name")


@query("ingest_again", f"WITH {TELEMETRY} SELECT id AS event_id FROM te WHERE event_name <> 'app_started'")
def q_ingest_again(spark, d):
    """With the app starts already stored only the others are new."""
    before = stored(spark, d).where("event_name = 'app_started'")
    return EV.ingest_events(telemetry_lines(spark, d), ["seq"], before).select("event_id")


@query("event_json", f"""WITH {TELEMETRY} SELECT id AS event_id, CAST(1 AS BIGINT) AS schema_version, event_name, CAST(round(value * 100) AS BIGINT) AS duration_ms FROM te""")
def q_event_json(spark, d):
    body = F.col("event_json")
    return stored(spark, d).select(F.get_json_object(body, "$.event_id").alias("event_id"), F.get_json_object(body, "$.schema_version").cast("bigint").alias("schema_version"),
                                   F.get_json_object(body, "$.event_name").alias("event_name"), F.get_json_object(body, "$.properties.duration_ms").cast("bigint").alias("duration_ms"))


@query("telemetry_totals", f"WITH {TELEMETRY} SELECT count(*) AS event_count, count(DISTINCT user_id) AS installation_count, min(seq) AS first_seq, max(seq) AS last_seq FROM te")
def q_totals(spark, d):
    out = EV.telemetry_totals(stored(spark, d))
    second = {n: F.floor((F.unix_micros(f"{n}_received_at") - START_US) / 1_000_000) for n in ("first", "last")}
    return out.select("event_count", "installation_count", second["first"].alias("first_seq"), second["last"].alias("last_seq"))


@query("telemetry_by_event", f"WITH {TELEMETRY} SELECT event_name, count(*) AS count, max(seq) AS last_seq FROM te GROUP BY 1")
def q_by_event(spark, d):
    out = EV.telemetry_by_event(stored(spark, d))
    return out.select("event_name", "count", F.floor((F.unix_micros("last_received_at") - START_US) / 1_000_000).alias("last_seq"))


@query("avg_decode_ms", f"WITH {TELEMETRY} SELECT round(avg(round(value * 100)), 6) AS avg_decode_ms FROM te WHERE event_name = 'load_decode_completed'")
def q_avg_decode(spark, d):
    return rounded(EV.avg_decode_ms(stored(spark, d)))


@query("recent_events", f"WITH {TELEMETRY} SELECT id AS event_id FROM te ORDER BY seq DESC LIMIT 100")
def q_recent(spark, d):
    return EV.recent_events(stored(spark, d)).select("event_id")


@query("export_ndjson", f"WITH {TELEMETRY} SELECT id AS event_id FROM te WHERE seq > 500 ORDER BY seq LIMIT 5000")
def q_export(spark, d):
    after = F.timestamp_micros(F.lit(START_US + 500_000_000))
    return EV.export_rows(stored(spark, d), after, limit=5000).select("event_id")


@query("export_all", f"WITH {TELEMETRY} SELECT id AS event_id, event_name FROM te WHERE seq > 500")
def q_export_all(spark, d):
    """Every event after a receive time."""
    after = F.timestamp_micros(F.lit(START_US + 500_000_000))
    return EV.export_rows(stored(spark, d), after).select("event_id", "event_name")


@query("event_properties", f"""WITH {TELEMETRY} SELECT id AS event_id,
  '{{"duration_ms":' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ',"kind_of":"' || event_type || '"}}' AS properties_json FROM te""")
def q_event_properties(spark, d):
    """JSON text of the properties: the number stays a number."""
    return stored(spark, d).select("event_id", F.regexp_extract("event_json", r'"properties":(.*)\}$', 1).alias("properties_json"))


@query("load_telemetry", f"WITH {TELEMETRY} SELECT id AS event_id, event_name FROM te")
def q_load_telemetry(spark, d):
    """The event lines as files, read in one batch."""
    folder = new_path(spark, "drop")
    lines = telemetry_lines(spark, d).repartitionByRange(F.floor(F.col("seq") / 10)).sortWithinPartitions("seq").select("value")
    lines.write.text(folder)
    return load_telemetry(spark, folder).select("event_id", "event_name")


@query("retain_recent", f"""WITH {TELEMETRY} SELECT seq FROM tl WHERE coalesce(error, '') IN ('invalid_json', 'event_must_be_object')
  OR ts >= TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 30 DAY""")
def q_retain(spark, d):
    now = F.lit("2024-02-20 00:00:00").cast("timestamp")
    return EV.retain_recent(telemetry_lines(spark, d), now, days=30).select("seq")


@query("stream_ingest", f"WITH {TELEMETRY} SELECT id AS event_id, event_name FROM te")
def q_stream(spark, d):
    """The event lines as files, taken in by a stream, and once more after a restart: the second run adds nothing."""
    folder, table, rejects, state = (new_path(spark, n) for n in ("drop", "events", "rejects", "state"))
    # An event and its copy stay in one file, in order.
    lines = telemetry_lines(spark, d).repartitionByRange(F.floor(F.col("seq") / 10)).sortWithinPartitions("seq").select("value")
    lines.write.text(folder)
    start_ingest(spark, folder, table, rejects, state).awaitTermination()
    lines.write.mode("append").text(folder)
    start_ingest(spark, folder, table, rejects, state).awaitTermination()
    return spark.read.parquet(table).select("event_id", "event_name")
