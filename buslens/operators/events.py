"""Usage events: validation, first-wins ingestion, retention and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.events import event_error, normalized_event, parse_event, with_properties
from buslens.plans.staging import keep_where


STORED = ["event_id", "event_name", "timestamp_utc", "app_version", "installation_id", "session_id", "os_description",
          "process_architecture", "runtime_version", "properties"]


def validate_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add error to every line; NULL marks an acceptable event."""
    return parse_event(lines, value).withColumn("error", event_error(F.col(value)))


def normalize_events(validated: DataFrame, carry: list[str]) -> DataFrame:
    """The stored form of the valid events, with the given columns of the input and the event as JSON text."""
    rows = with_properties(keep_where(validated, F.col("error").isNull()))
    rows = rows.select(*carry, *[c.alias(n) for n, c in normalized_event().items()], "properties", "properties_json")
    iso = F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    head = F.struct(F.lit(1).alias("schema_version"), *[iso.alias(c) if c == "timestamp_utc" else F.col(c) for c in STORED if c != "properties"])
    # Properties come last in the event, with the JSON types they had.
    opened = F.regexp_replace(F.to_json(head, {"ignoreNullFields": "false"}), r"\}$", "")
    return rows.withColumn("event_json", F.concat(opened, F.lit(',"properties":'), F.col("properties_json"), F.lit("}")))


def first_per_id(events: DataFrame, order: list[str]) -> DataFrame:
    """The first event of every id. An aggregate, so copies of one id combine before the shuffle."""
    # Map columns cannot be compared, so the row is picked by its order, not compared itself.
    row = F.struct(*[c for c in events.columns if c != "event_id"])
    return events.groupBy("event_id").agg(F.min_by(row, F.struct(*order)).alias("r")).select("event_id", "r.*")


def ingest_events(lines: DataFrame, order: list[str], existing: DataFrame | None = None, *, received_at: Column | None = None,
                  value: str = "value") -> DataFrame:
    """New rows of the event table: valid, normalised, first of their id, and not stored yet."""
    fresh = first_per_id(normalize_events(validate_events(lines, value), order), order)
    if existing is not None:
        fresh = fresh.join(existing.select("event_id"), "event_id", "left_anti")
    return fresh.withColumn("received_at", received_at if received_at is not None else F.current_timestamp())


def rejected_events(lines: DataFrame, value: str = "value") -> DataFrame:
    return keep_where(validate_events(lines, value), F.col("error").isNotNull()).select(*lines.columns, "error")


def retain_recent(lines: DataFrame, now: Column, days: int = 365, value: str = "value") -> DataFrame:
    """Event lines from the last days. Lines whose time cannot be read stay."""
    if days < 0:
        raise ValueError("days must not be negative")
    at = parse_event(lines, value).withColumn("cutoff", now - F.make_dt_interval(F.lit(int(days))))
    return at.where(F.col("event_time").isNull() | (F.col("event_time") >= F.col("cutoff"))).select(*lines.columns)


def telemetry_totals(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("installation_id").alias("installation_count"),
                      F.min("received_at").alias("first_received_at"), F.max("received_at").alias("last_received_at"))


def telemetry_by_event(events: DataFrame) -> DataFrame:
    return events.groupBy("event_name").agg(F.count(F.lit(1)).alias("count"),
                                            F.max("received_at").alias("last_received_at")).orderBy("event_name")


def avg_decode_ms(events: DataFrame) -> DataFrame:
    """Mean duration of completed loads, over those that carry a number."""
    ms = F.col("properties")["duration_ms"].try_cast("double")
    finite = ms.isNotNull() & ~F.isnan(ms) & (F.abs(ms) < float("inf"))
    return events.where(F.col("event_name") == "load_decode_completed").agg(F.avg(F.when(finite, ms)).alias("avg_decode_ms"))


def recent_events(events: DataFrame, limit: int = 100) -> DataFrame:
    """The latest events."""
    return events.orderBy(F.desc("received_at"), "event_id").limit(limit)


def export_rows(events: DataFrame, after: Column | None = None, limit: int | None = None) -> DataFrame:
    """The events after a receive time, oldest first: all, or the first `limit`."""
    rows = events if after is None else events.where(F.col("received_at") > after)
    rows = rows.orderBy("received_at", "event_id")
    return rows if limit is None else rows.limit(limit)
