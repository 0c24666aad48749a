"""Usage events as JSON text: reading, checking and normalising one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.time import trimmed

# Fixed values of the event contract.
EVENT_NAMES = [
    "app_started", "load_decode_completed", "load_decode_failed", "load_decode_cancelled", "export_decoded_csv",
    "settings_applied", "analysis_layout_exported", "analysis_layout_imported", "analysis_apply_plot_groups",
    "analysis_open_detached_plots", "analysis_lod_forced", "update_check_skipped", "update_check_completed",
    "update_prompt_declined", "update_apply_failed",
]
REQUIRED = ["event_id", "timestamp_utc", "installation_id", "session_id"]
MAX_BODY, MAX_PROPERTIES = 32 * 1024, 8 * 1024
FIELD_LENGTHS = {
    "event_id": 80, "event_name": 80, "app_version": 80, "installation_id": 80, "session_id": 80, "os_description": 160,
    "process_architecture": 32, "runtime_version": 80,
}
KEY_LENGTH, TEXT_LENGTH = 64, 120


_FIELDS = [*FIELD_LENGTHS, "timestamp_utc", "properties"]


def _text(field: Column) -> Column:
    """A JSON text without surrounding white space; empty if missing or of another type."""
    return F.when(F.schema_of_variant(field) == "STRING", trimmed(F.try_variant_get(field, "$", "string"))).otherwise("")


def parse_event(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add is_json, is_object, the event's properties (variant) and its text fields as raw_*."""
    # One parse; all fields are looked up in its result.
    rows = lines.withColumn("j", F.try_parse_json(F.col(value)))
    rows = rows.withColumns({f"__{n}": F.try_variant_get("j", f"$.{n}", "variant") for n in _FIELDS})
    rows = rows.withColumns({
        "is_json": F.col("j").isNotNull(),
        "is_object": trimmed(F.col(value)).startswith("{"),
        **{f"raw_{n}": _text(F.col(f"__{n}")) for n in _FIELDS if n != "properties"},
        "name_text": F.try_variant_get("__event_name", "$", "string"),
        "properties_raw": F.col("__properties"),
    }).drop("j", *[f"__{n}" for n in _FIELDS])
    return rows.withColumn("event_time", F.col("raw_timestamp_utc").try_cast("timestamp"))


def event_error(value: Column) -> Column:
    """NULL for a valid event, else the code of the first rule it breaks."""
    # The event name must match exactly, so its untrimmed text counts.
    error = (F.when(F.length(value) > MAX_BODY, "payload_too_large").when(~F.col("is_json"), "invalid_json")
             .when(~F.col("is_object"), "event_must_be_object")
             .when(~F.coalesce(F.col("name_text").isin(EVENT_NAMES), F.lit(False)), "unknown_event_name"))
    for name in REQUIRED:
        error = error.when(F.col(f"raw_{name}") == "", f"missing_{name}")
    # Written out, numbers may grow, but not beyond forty digits: short lines need no look.
    too_large = F.when(F.length(value) * 20 <= MAX_PROPERTIES, False).otherwise(F.length(F.to_json("properties_raw")) > MAX_PROPERTIES)
    return error.when(F.col("event_time").isNull(), "invalid_timestamp_utc").when(too_large, "properties_too_large")


def with_properties(rows: DataFrame) -> DataFrame:
    """Add properties MAP<STRING,STRING> for look-ups and properties_json from properties_raw; anything but an object gives {}.

    Keys become safe and at most 64 long, texts at most 120; numbers, booleans and null stay what they are in the JSON. Of keys
    that become equal the last one counts.
    """
    entries = F.map_entries(F.try_variant_get("properties_raw", "$", "map<string,variant>"))
    kinds = F.transform(entries, lambda e: F.struct(
        F.substring(F.regexp_replace(e["key"], "[^A-Za-z0-9_-]", "_"), 1, KEY_LENGTH).alias("key"),
        F.schema_of_variant(e["value"]).alias("kind"), e["value"].alias("value")))

    def text(e: Column) -> Column:
        plain = F.try_variant_get(e["value"], "$", "string")
        listed = F.array_join(F.try_variant_get(e["value"], "$", "array<string>"), ",", "")
        return (F.when(e["kind"] == "STRING", F.substring(plain, 1, TEXT_LENGTH))
                .when(e["kind"].startswith("ARRAY"), F.substring(listed, 1, TEXT_LENGTH))
                .when(e["kind"].startswith("OBJECT"), "[object Object]").otherwise(plain))

    # The text of a value is worked out once, in a step of its own.
    rows = rows.withColumn("__kinds", F.filter(kinds, lambda e: e["key"] != ""))
    rows = rows.withColumn("__texts", F.transform("__kinds", lambda e: F.struct(e["key"].alias("key"), e["kind"].alias("kind"), e["value"].alias("value"), text(e).alias("text"))))

    def as_json(e: Column) -> Column:
        # to_json() of a variant writes its JSON form; texts are written as the cut text.
        kept = e["kind"].startswith("ARRAY") | e["kind"].startswith("OBJECT") | (e["kind"] == "STRING")
        escaped = F.regexp_replace(F.to_json(F.array(e["text"])), r"^\[|\]$", "")
        quoted = F.when(e["text"].rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(F.concat(F.lit('"'), e["text"], F.lit('"')))
        return F.when(kept, quoted).otherwise(F.coalesce(F.to_json(e["value"]), F.lit("null")))

    rows = rows.withColumn("__named", F.transform("__texts", lambda e: F.struct(
        e["key"].alias("key"), e["text"].alias("value"), F.concat(F.lit('"'), e["key"], F.lit('":'), as_json(e)).alias("json"))))
    named = F.col("__named")
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]))
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    once = F.size(F.array_distinct(F.transform(named, lambda e: e["key"]))) == F.size(named)
    rows = rows.withColumn("__last", F.when(once, named).otherwise(last))
    pairs = F.transform("__last", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    body = F.array_join(F.transform("__last", lambda e: e["json"]), ",")
    return rows.withColumns({"properties": F.coalesce(F.map_from_entries(pairs), empty),
                             "properties_json": F.concat(F.lit("{"), F.coalesce(body, F.lit("")), F.lit("}"))}).drop("__kinds", "__texts", "__named", "__last")


def normalized_event() -> dict[str, Column]:
    """The stored columns of a valid event, next to its properties."""
    cut = {n: F.substring(F.col(f"raw_{n}"), 1, size) for n, size in FIELD_LENGTHS.items()}
    return {**cut, "timestamp_utc": F.date_trunc("millisecond", F.col("event_time"))}
