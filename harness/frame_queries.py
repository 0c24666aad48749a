"""Decoding, frame views and bus traffic."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from buslens.functions.frame import frame_duration
from buslens.functions.ids import hex_token, j1939_pgn, parse_id
from buslens.functions.labels import short_label, signal_label
from buslens.operators import decode as D
from buslens.operators import frames as FR
from buslens.operators import traffic as TR
from buslens.operators.catalog import catalog_from_rows
from buslens.plans.staging import new_path
from buslens.sinks.exports import decoded_export
from buslens.sinks.frame_store import ranked_count, ranked_page, write_by_id, write_ranked
from buslens.sources.readers import read_log
from harness.registry import query, rounded
from harness.views import DECODED, EXT_ID, FRAMES, LINES, candump_logs, catalog, decoder, events, frames, log_glob, recording, table


@query("log_to_watch", f"""WITH {LINES}, s AS (SELECT *, CASE WHEN can_id < 280 THEN 'Msg' || CAST(can_id AS VARCHAR) WHEN is_extended THEN 'Group' END AS message_name FROM ok),
v AS (SELECT s.*, 'EventId' AS signal_name, CAST(event_id AS DOUBLE) AS v, '0x' || CASE WHEN event_id = 0 THEN '0' ELSE printf('%X', event_id) END AS raw_hex, '' AS unit FROM s
  UNION ALL SELECT s.*, 'Value', round(ev_value * 100) * 0.01, '0x' || printf('%X', CAST(round(ev_value * 100) AS BIGINT)), 'V' FROM s)
SELECT recording, channel, frame_format, is_extended, can_id AS frame_id, message_name, signal_name, count(*) AS updates, round(min(v), 6) AS minimum, round(max(v), 6) AS maximum,
  arg_max(rel_ns, frame_no) AS last_ts_ns, max(frame_no) AS last_frame_index, round(arg_max(v, frame_no), 6) AS last_value, arg_max(raw_hex, frame_no) AS last_raw_hex, unit
FROM (SELECT *, 'Classic' AS frame_format FROM v WHERE message_name IS NOT NULL) GROUP BY ALL""")
def q_log_to_watch(spark, d):
    log = read_log(spark, log_glob(candump_logs(spark, d)), "candump")
    samples = D.decode(log.frames, decoder(spark)).samples.drop("raw_value")
    keys = ["source_file", "channel", "frame_format", "is_extended", "frame_id", "message_name", "signal_name"]
    watch = FR.signal_watch(samples, keys).withColumn("recording", recording()).drop("source_file")
    return rounded(watch)


def decoded(spark, d):
    return D.decode(frames(spark, d), decoder(spark))


@query("decode_signals", f"""WITH {DECODED} SELECT frame_index, source_line, ts_ns, channel, is_extended, frame_id, message_name, signal_name, unit,
  round(value, 6) AS value, CAST(raw_value AS DECIMAL(38,0)) AS raw_value FROM sm""")
def q_decode_signals(spark, d):
    return rounded(decoded(spark, d).samples.select("frame_index", "source_line", "ts_ns", "channel", "is_extended", "frame_id", "message_name",
                                                    "signal_name", "unit", "value", "raw_value"))


@query("decode_exact", f"WITH {DECODED} SELECT frame_index, can_id, decode_status, message_name FROM de WHERE NOT is_extended")
def q_decode_exact(spark, d):
    return decoded(spark, d).frames.where(~F.col("is_extended")).select("frame_index", "can_id", "decode_status", "message_name")


@query("decode_pgn", f"""WITH {FRAMES} SELECT frame_index, can_id, CASE WHEN can_id = {EXT_ID} THEN 'decoded' ELSE 'ambiguous' END AS decode_status,
  CASE WHEN can_id = {EXT_ID} THEN 'Group' END AS message_name, CAST(65360 AS BIGINT) AS pgn FROM fr WHERE is_extended""")
def q_decode_pgn(spark, d):
    """With a second message of the group, only the exact id is still clear."""
    cat = catalog(spark)
    twin = catalog_from_rows(spark, [(90, 0x80000000 + EXT_ID + 0x2000000 + 99, "Twin", 8)], [])
    both = type(cat)(cat.messages.unionByName(twin.messages), cat.signals)
    out = D.decode(frames(spark, d), both).frames.where("is_extended")
    return out.select("frame_index", "can_id", "decode_status", "message_name", j1939_pgn(F.col("frame_id")).alias("pgn"))


@query("unmatched_frames", f"WITH {DECODED} SELECT frame_index, can_id FROM de WHERE decode_status = 'unmatched'")
def q_unmatched(spark, d):
    return D.unmatched_frames(decoded(spark, d).frames).select("frame_index", "can_id")


@query("message_summary", f"WITH {DECODED} SELECT can_id AS frame_id, message_name, count(*) AS frames FROM de WHERE decode_status = 'decoded' GROUP BY ALL")
def q_message_summary(spark, d):
    return D.message_summary(decoded(spark, d).frames)


@query("decode_diagnostics", f"""WITH {DECODED} SELECT count(*) AS frames, count(DISTINCT can_id) AS unique_ids,
  count(*) FILTER (decode_status = 'decoded') AS decoded_frames, count(*) FILTER (decode_status = 'unmatched') AS unmatched_frames,
  count(DISTINCT can_id) FILTER (decode_status = 'unmatched') AS unmatched_ids, count(*) FILTER (decode_status = 'error') AS error_frames,
  count(DISTINCT can_id) FILTER (decode_status = 'error') AS error_ids, CAST(0 AS BIGINT) AS ambiguous_frames, CAST(0 AS BIGINT) AS ambiguous_ids,
  CAST(26 AS BIGINT) AS dbc_messages, CAST(25 AS BIGINT) AS std_messages, CAST(1 AS BIGINT) AS ext_messages, 2 * count(*) FILTER (decode_status = 'decoded') AS samples FROM de""")
def q_decode_diagnostics(spark, d):
    out = decoded(spark, d)
    return D.decode_diagnostics(out.frames, catalog(spark), out.samples)


@query("top_unmatched", f"""WITH {DECODED} SELECT can_id, count(*) AS frames, can_id > 2047 AS is_extended, can_id AS frame_id FROM de
  WHERE decode_status = 'unmatched' GROUP BY can_id ORDER BY frames DESC, can_id LIMIT 12""")
def q_top_unmatched(spark, d):
    return D.top_unmatched(decoded(spark, d).frames, catalog(spark)).select("can_id", "frames", "is_extended", "frame_id")


@query("top_decode_errors", f"WITH {DECODED} SELECT can_id, count(*) AS frames FROM de WHERE decode_status = 'error' GROUP BY can_id ORDER BY frames DESC, can_id LIMIT 12")
def q_top_errors(spark, d):
    return D.top_decode_errors(decoded(spark, d).frames)


@query("dbc_examples", """WITH m AS (SELECT o_orderkey % 2048 AS frame_id, o_orderkey, row_number() OVER (ORDER BY o_orderkey % 2048, o_orderkey) AS rn FROM orders)
SELECT 'Order' || CAST(o_orderkey AS VARCHAR) AS name, CAST(frame_id AS BIGINT) AS frame_id FROM m WHERE rn <= 12""")
def q_dbc_examples(spark, d):
    from harness.views import order_catalog
    return D.dbc_examples(order_catalog(spark, d)).select("name", "frame_id")


@query("frame_samples", f"""WITH {DECODED} SELECT s.frame_index, message_name, signal_name, round(s.value, 6) AS value FROM sm s
  JOIN (SELECT DISTINCT event_id AS frame_index FROM events WHERE event_type = 'error') USING (frame_index)""")
def q_frame_samples(spark, d):
    wanted = events(spark, d).where(F.col("event_type") == "error").select(F.col("event_id").alias("frame_index"))
    return rounded(D.frame_samples(decoded(spark, d).samples, wanted).select("frame_index", "message_name", "signal_name", "value"))


def rich_catalog(spark):
    """One message per standard id with multiplexed, signed, Intel, Motorola and IEEE fields over the same eight bytes."""
    signals = [
        ("mux", 48, 2, True, False, "Integer", True, []), ("low", 56, 8, True, False, "Integer", False, [0]),
        ("signed", 56, 8, True, True, "Integer", False, [1]), ("whole", 0, 48, True, False, "Integer", False, [2]),
        ("float", 32, 16, True, False, "IeeeFloat32", False, [3])]
    messages = [(i, 256 + i, f"Rich{i}", 8) for i in range(32)]
    rows = [(m, n, name, start, length, intel, signed, 0.5 if name == "signed" else 1.0, -1.0 if name == "signed" else 0.0, 0.0, 0.0, "", mux, ids, [], kind)
            for m in range(32) for n, (name, start, length, intel, signed, kind, mux, ids) in enumerate(signals)]
    return catalog_from_rows(spark, messages, rows)


RAW = "CAST(round(ev_value * 100) AS BIGINT)"


@query("decode_mux", f"""WITH {FRAMES}, b AS (SELECT frame_index, event_id, {RAW} AS raw FROM fr WHERE NOT is_extended),
c AS (SELECT *, (raw >> 8) & 255 AS byte6, raw & 255 AS byte7, event_id & 281474976710655 AS six FROM b),
m AS (SELECT *, byte6 & 3 AS mux FROM c)
SELECT frame_index, 'mux' AS signal_name, CAST(mux AS DOUBLE) AS value, '0x' || printf('%X', mux) AS raw_hex FROM m
UNION ALL SELECT frame_index, 'low', CAST(byte7 AS DOUBLE), '0x' || printf('%X', byte7) FROM m WHERE mux = 0
UNION ALL SELECT frame_index, 'signed', (CASE WHEN byte7 > 127 THEN byte7 - 256 ELSE byte7 END) * 0.5 - 1.0, '0x' || printf('%X', byte7) FROM m WHERE mux = 1
UNION ALL SELECT frame_index, 'whole', CAST(((six & 255) << 40) + (((six >> 8) & 255) << 32) + (((six >> 16) & 255) << 24) + (((six >> 24) & 255) << 16) + (((six >> 32) & 255) << 8) + (six >> 40) AS DOUBLE),
  '0x' || printf('%X', ((six & 255) << 40) + (((six >> 8) & 255) << 32) + (((six >> 16) & 255) << 24) + (((six >> 24) & 255) << 16) + (((six >> 32) & 255) << 8) + (six >> 40)) FROM m WHERE mux = 2""")
def q_decode_mux(spark, d):
    """The IEEE field has the wrong length, so it never yields a value."""
    std = frames(spark, d).where(~F.col("is_extended"))
    return D.decode(std, rich_catalog(spark)).samples.select("frame_index", "signal_name", "value", "raw_hex")


@query("decode_ieee", """WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS n, l_extendedprice AS price FROM lineitem)
SELECT 'f64' AS signal_name, count(*) AS samples, round(sum(price), 2) AS total, round(min(price), 2) AS lowest, round(max(price), 2) AS highest FROM p""")
def q_decode_ieee(spark, d):
    """Prices packed as IEEE doubles by arithmetic, sent as frames and read back."""
    from harness.views import table
    price = F.col("l_extendedprice").cast("double")
    exponent = F.floor(F.log2(price))
    mantissa = ((price / F.pow(F.lit(2.0), exponent) - 1.0) * F.lit(float(1 << 52))).cast("bigint")
    bits = (F.shiftleft((exponent + 1023).cast("bigint"), 52)).bitwiseOR(mantissa)
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame_index"), F.lit(0).cast("long").alias("ts_ns"), F.lit(64).cast("long").alias("can_id"),
        F.lit(False).alias("is_extended"), F.lit(8).alias("dlc"), F.unhex(F.lpad(F.hex(bits), 16, "0")).alias("payload"), F.lit(8).alias("payload_len"),
        F.lit("").alias("channel"), F.lit("Classic").alias("frame_format"))
    cat = catalog_from_rows(spark, [(0, 64, "Price", 8)], [(0, 0, "f64", 7, 64, False, False, 1.0, 0.0, 0.0, 0.0, "", False, [], [], "IeeeFloat64")])
    return D.decode(rows, cat).samples.groupBy("signal_name").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum("value"), 2).alias("total"), F.round(F.min("value"), 2).alias("lowest"), F.round(F.max("value"), 2).alias("highest"))


@query("filter_frames", f"""WITH {FRAMES} SELECT frame_index, can_id, channel FROM fr WHERE '0x' || printf('%X', can_id) LIKE '%x11%'""")
def q_filter_frames(spark, d):
    return FR.filter_frames(frames(spark, d), id_text="X11").select("frame_index", "can_id", "channel")


@query("filter_frames_combined", f"""WITH {FRAMES} SELECT frame_index, can_id, channel FROM fr WHERE contains(data_hex, '0A') AND frame_type = 'Rx' AND channel = 'can1'
  AND ts_ns / 1e9 >= 100000.5 AND ts_ns / 1e9 <= 2000000.25 AND NOT is_extended""")
def q_filter_combined(spark, d):
    return FR.filter_frames(frames(spark, d), payload_hex="0x0 a", type_text="rX", channel_text="CAN1", time_start=100000.5, time_end=2000000.25,
                            is_extended=False).select("frame_index", "can_id", "channel")


@query("page_frames", f"WITH {FRAMES} SELECT frame_index, can_id FROM fr ORDER BY frame_index LIMIT 50 OFFSET 100")
def q_page_frames(spark, d):
    return FR.page_frames(frames(spark, d), 100, 50).select("frame_index", "can_id")


FILES = f"""{FRAMES}, ff AS (SELECT fr.* REPLACE (row_number() OVER (PARTITION BY event_type ORDER BY frame_index) - 1 AS frame_index), event_type AS source_file
  FROM fr JOIN (SELECT event_id, event_type FROM events) USING (event_id))"""


def file_frames(spark, d):
    """The frames as one recording per event type, each numbered from 0."""
    kinds = table(spark, d, "events").select(F.col("event_id").alias("frame_index"), F.col("event_type").alias("source_file"))
    place = F.row_number().over(Window.partitionBy("source_file").orderBy("frame_index")) - 1
    return frames(spark, d).join(kinds, "frame_index").withColumn("frame_index", place.cast("long"))


@query("ranked_page", f"""WITH {FILES} SELECT source_file, frame_index, can_id, channel FROM (SELECT *, row_number() OVER (ORDER BY source_file, frame_index) AS n FROM ff)
  WHERE n > (SELECT count(*) FROM ff) // 2 AND n <= (SELECT count(*) FROM ff) // 2 + 5000""")
def q_ranked_page(spark, d):
    path = new_path(spark, "ranked")
    write_ranked(file_frames(spark, d), path)
    return ranked_page(spark, path, ranked_count(spark, path) // 2, 5000).select("source_file", "frame_index", "can_id", "channel")


@query("filter_by_id", f"""WITH {FRAMES} SELECT frame_index, can_id, channel, ts_ns FROM fr WHERE can_id = 273 AND ts_ns / 1e9 >= 100000.5 AND ts_ns / 1e9 <= 20000000.25""")
def q_filter_by_id(spark, d):
    path = new_path(spark, "by_id")
    write_by_id(frames(spark, d), path)
    return FR.filter_frames(spark.read.parquet(path), id_text="0x111", time_start=100000.5, time_end=20000000.25).select("frame_index", "can_id", "channel", "ts_ns")


@query("page_after_files", f"""WITH {FILES}, o AS (SELECT *, row_number() OVER (ORDER BY source_file, frame_index) AS n FROM ff)
SELECT source_file, frame_index, can_id FROM o WHERE n > (SELECT n FROM o WHERE source_file = 'click' AND frame_index = 20) ORDER BY n LIMIT 5000""")
def q_page_after_files(spark, d):
    return FR.page_after(file_frames(spark, d), ("click", 20), 5000).select("source_file", "frame_index", "can_id")


@query("page_after", f"WITH {FRAMES} SELECT frame_index, can_id FROM fr WHERE frame_index > 149 ORDER BY frame_index LIMIT 50")
def q_page_after(spark, d):
    return FR.page_after(frames(spark, d), 149, 50).select("frame_index", "can_id")


@query("message_window", f"""WITH {DECODED}, w AS (SELECT *, '0x' || printf('%X', can_id) AS id_hex, trim(regexp_replace(data_hex, '(..)', '\\1 ', 'g')) AS spaced FROM de)
SELECT frame_index, id_hex, spaced AS data_hex, message_name IS NOT NULL AS is_decoded, coalesce(message_name, id_hex) AS message_name FROM w
WHERE lower(id_hex) LIKE '%sg2%' OR lower(coalesce(message_name, id_hex)) LIKE '%sg2%' OR lower(spaced) LIKE '%sg2%'""")
def q_message_window(spark, d):
    rows = FR.message_window(frames(spark, d), decoded(spark, d).samples, search="sG2")
    return rows.select("frame_index", "id_hex", "data_hex", "is_decoded", "message_name")


WATCH = f"""WITH {DECODED}, w AS (SELECT channel, is_extended, frame_id, message_name, signal_name, count(*) AS updates, round(min(value), 6) AS minimum, round(max(value), 6) AS maximum,
  arg_max(ts_ns, frame_index) AS last_ts_ns, max(frame_index) AS last_frame_index, round(arg_max(value, frame_index), 6) AS last_value, unit FROM sm GROUP BY ALL)"""
WATCH_KEYS = ["channel", "is_extended", "frame_id", "message_name", "signal_name"]


def watch(spark, d):
    return FR.signal_watch(decoded(spark, d).samples, WATCH_KEYS).select(
        *WATCH_KEYS, "updates", "minimum", "maximum", "last_ts_ns", "last_frame_index", "last_value", "unit")


@query("signal_watch", WATCH + " SELECT * FROM w")
def q_signal_watch(spark, d):
    return rounded(FR.watch_order(watch(spark, d)))


@query("search_watch", WATCH + " SELECT * FROM w WHERE lower(signal_name) LIKE '%ven%' OR lower(message_name) LIKE '%ven%' OR lower(channel) LIKE '%ven%' OR lower(unit) LIKE '%ven%' OR lower('0x' || printf('%X', frame_id)) LIKE '%ven%'")
def q_search_watch(spark, d):
    return rounded(FR.search_watch(watch(spark, d), " vEn "))


@query("signal_catalog", f"""WITH {DECODED} SELECT channel, is_extended, frame_id, message_name, signal_name, count(*) AS samples,
  message_name || '.' || signal_name || ' [' || channel || ' | CAN | ' || CASE WHEN is_extended THEN 'Ext' ELSE 'Std' END || ' | 0x' || printf('%X', frame_id) || ']' AS label,
  signal_name AS short FROM sm GROUP BY ALL""")
def q_signal_catalog(spark, d):
    keys = ["frame_format", *WATCH_KEYS]
    rows = FR.signal_catalog(decoded(spark, d).samples, keys).withColumn("label", signal_label())
    return rows.withColumn("short", short_label(F.col("label"))).drop("frame_format")


@query("search_signals", f"""WITH {DECODED} SELECT DISTINCT message_name, signal_name FROM sm WHERE lower(message_name || '.' || signal_name) LIKE '%258.v%'""")
def q_search_signals(spark, d):
    rows = FR.signal_catalog(decoded(spark, d).samples, ["message_name", "signal_name"])
    label = F.concat("message_name", F.lit("."), "signal_name")
    return FR.search_signals(rows, label, "258.V").select("message_name", "signal_name")


@query("distinct_channels", f"WITH {FRAMES} SELECT DISTINCT channel FROM fr")
def q_channels(spark, d):
    return FR.distinct_channels(frames(spark, d))


@query("export_decoded", f"""WITH {DECODED} SELECT round(ts_ns / 1e9, 6) AS time_s, frame_id, message_name, signal_name, round(value, 6) AS value,
  message_name || '.' || signal_name || ' [' || channel || ' | CAN | ' || CASE WHEN is_extended THEN 'Ext' ELSE 'Std' END || ' | 0x' || printf('%X', frame_id) || ']' AS label,
  ts_ns AS time_ns, frame_index, source_line, channel, 'Classic' AS frame_format, is_extended, CAST(8 AS INT) AS dlc_code, CAST(8 AS INT) AS payload_length,
  CAST(raw_value AS VARCHAR) AS raw_value, unit, 'Valid' AS decode_quality, 'COMPLETE' AS dataset_status, 'AA' AS source_log_sha256, '' AS dbc_sha256,
  '1.0.0' AS app_version, 'Strict' AS import_mode FROM sm""")
def q_export_decoded(spark, d):
    meta = {"dataset_status": "COMPLETE", "source_log_sha256": "AA", "app_version": "1.0.0", "import_mode": "Strict"}
    return rounded(decoded_export(decoded(spark, d).samples, None, meta))


@query("frame_duration", f"""WITH {FRAMES} SELECT frame_index, round((CASE WHEN is_extended THEN 67 ELSE 47 END + 64 + 3) * 1.2 / 500000, 9) AS classic_s,
  round((CASE WHEN is_extended THEN 41 ELSE 23 END) * 1.2 / 500000 + (64 + 17 + 13) * 1.2 / CASE WHEN event_id % 2 = 0 THEN 2000000 ELSE 500000 END, 9) AS fd_s FROM fr""")
def q_frame_duration(spark, d):
    def span(fmt):
        return F.round(frame_duration(F.lit(fmt), F.col("is_extended"), F.col("payload_len"), F.col("frame_index") % 2 == 0, 500_000, 2_000_000), 9)
    return frames(spark, d).select("frame_index", span("Classic").alias("classic_s"), span("FlexibleDataRate").alias("fd_s"))


@query("parse_id", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS BIGINT) WHEN p_partkey % 3 = 1 THEN CAST(('0x' || printf('%X', p_partkey)) AS BIGINT) ELSE
  CAST(('0x' || printf('%X', p_partkey) || 'F') AS BIGINT) END AS id, printf('%X', p_partkey) || 'F' AS token FROM part""")
def q_parse_id(spark, d):
    from harness.views import table
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("0x"), F.lower(F.hex(k)))).otherwise(F.concat(F.hex(k), F.lit("F")))
    token = F.concat(F.lit(" 0x"), F.lower(F.hex(k)), F.lit(" f "))
    return table(spark, d, "part").select("p_partkey", parse_id(text).alias("id"), hex_token(token).alias("token"))


@query("frame_id_filter", f"WITH {DECODED} SELECT frame_index, signal_name FROM sm WHERE frame_id = 258")
def q_frame_id_filter(spark, d):
    return FR.frame_id_filter(decoded(spark, d).samples, "0x102").select("frame_index", "signal_name")


@query("parse_timestamps", """WITH x AS (SELECT event_id, (epoch_us(ts) - 1704067200000000) * 1000 AS ns FROM events)
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ns + 7 END AS seconds_ns, ns + 1 AS millis_ns, ns % 86400000000000 + 5 AS tod_ns, (ns // 1000000) * 1000000 AS css_ns FROM x""")
def q_timestamps(spark, d):
    from buslens.functions.time import ts_css_ns, ts_millis_ns, ts_seconds_ns, ts_tod_ns
    ns, at = F.col("ts_ns"), F.col("ts").cast("timestamp")
    whole = F.format_string("%d.%09d", F.floor(ns / 1_000_000_000), ns % 1_000_000_000 + 7)
    finer = F.concat(whole, F.when(F.col("event_id") % 9 == 0, "1").otherwise("0"))
    millis = F.format_string("%d,%06d", F.floor(ns / 1_000_000), ns % 1_000_000 + 1)
    tod = F.concat(F.date_format(at, "H:m:s"), F.lit(":"), F.lpad((ns % 1_000_000_000 + 5).cast("string"), 9, "0"))
    css = F.concat(F.lpad((F.floor(ns / 86_400_000_000_000) + 1).cast("string"), 2, "0"), F.lit("T"), F.date_format(at, "HHmmssSSS"))
    return events(spark, d).select("event_id", ts_seconds_ns(finer).alias("seconds_ns"), ts_millis_ns(millis).alias("millis_ns"),
                                   ts_tod_ns(tod).alias("tod_ns"), ts_css_ns(css).alias("css_ns"))


@query("j1939_pgn", """WITH x AS (SELECT o_orderkey, (o_orderkey * 7919) % 536870912 AS id FROM orders)
SELECT o_orderkey, CASE WHEN id > 2047 THEN ((id >> 24) & 1) * 65536 + ((id >> 16) & 255) * 256 + CASE WHEN ((id >> 16) & 255) >= 240 THEN (id >> 8) & 255 ELSE 0 END END AS pgn FROM x""")
def q_pgn(spark, d):
    from harness.views import table
    return table(spark, d, "orders").select("o_orderkey", j1939_pgn((F.col("o_orderkey") * 7919) % 536870912).cast("bigint").alias("pgn"))


@query("normalize_frame", """WITH x AS (SELECT l_orderkey % 700 * 4 AS id, l_linenumber % 2 = 0 AS ext, CAST(l_quantity AS INT) AS declared, CAST(l_suppkey % 66 AS INT) AS n, l_linenumber = 3 AS mark FROM lineitem),
f AS (SELECT *, mark OR n > 8 OR declared > 8 AS fd, list_position([0,1,2,3,4,5,6,7,8,12,16,20,24,32,48,64], n) - 1 AS code, [0,1,2,3,4,5,6,7,8,12,16,20,24,32,48,64][declared + 1] AS meant FROM x),
g AS (SELECT *, CASE WHEN NOT ext AND id > 2047 THEN 'identifier out of range' WHEN n > 64 THEN 'payload length out of range' WHEN NOT fd AND declared <> n THEN 'length code does not match payload'
  WHEN fd AND code IS NULL THEN 'payload length has no CAN FD code' WHEN fd AND declared <> n AND NOT coalesce(declared <= 15 AND meant = n, false) THEN 'declared CAN FD length does not match payload' END AS error FROM f)
SELECT coalesce(error, 'ok') AS outcome, CASE WHEN error IS NULL THEN CAST(CASE WHEN fd THEN code ELSE declared END AS INT) END AS dlc, fd AS is_fd, count(*) AS frames FROM g GROUP BY ALL""")
def q_normalize_frame(spark, d):
    from buslens.functions.frame import with_frame_checks
    from harness.views import table
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 700 * 4).cast("bigint").alias("can_id"), (F.col("l_linenumber") % 2 == 0).alias("is_extended"), F.col("l_quantity").cast("int").alias("declared"),
        (F.col("l_suppkey") % 66).cast("int").alias("payload_len"), (F.col("l_linenumber") == 3).alias("fd_marker"))
    out = with_frame_checks(rows)
    ok = F.col("frame_error").isNull()
    return out.groupBy(F.coalesce("frame_error", F.lit("ok")).alias("outcome"), F.when(ok, F.col("dlc")).alias("dlc"),
                       (F.col("frame_format") == "FlexibleDataRate").alias("is_fd")).agg(F.count(F.lit(1)).alias("frames"))


# --- traffic ---
SPAN = f"""{FRAMES}, sp AS (SELECT min(ts_ns / 1e9) AS start_s, max(ts_ns / 1e9) AS end_s, count(*) AS n FROM fr),
bn AS (SELECT *, greatest(1e-9, end_s - start_s) AS dur, greatest(1, ceil(greatest(1e-9, end_s - start_s) / CAST(5 AS DOUBLE)) + 1) AS wanted FROM sp),
bw AS (SELECT *, CAST(5 AS DOUBLE) AS w, CAST(wanted AS BIGINT) AS bins FROM bn),
fb AS (SELECT greatest(0, least(CAST(floor((ts_ns / 1e9 - start_s) / w) AS BIGINT), bins - 1)) AS bin, count(*) AS frames,
  sum((CASE WHEN is_extended THEN 67 ELSE 47 END + 64 + 3) * CAST(1.2 AS DOUBLE) / 500000) AS busy FROM fr, bw GROUP BY 1)"""


@query("bus_trend", f"""WITH {SPAN} SELECT CAST(g.bin AS INT) AS bin, start_s + g.bin * w AS time_s, coalesce(frames, 0) AS frames, round(coalesce(frames, 0) / w, 5) AS frames_per_s,
  round(coalesce(busy, 0) / w * 100, 5) AS load_pct FROM bw, (SELECT unnest(range(bins)) AS bin FROM bw) g LEFT JOIN fb USING (bin)""")
def q_bus_trend(spark, d):
    out = TR.bus_trend(frames(spark, d), bin_ms=5000).drop("source_file").withColumn("bin", F.col("bin").cast("int"))
    return out.withColumns({c: F.round(c, 5) for c in ("frames_per_s", "load_pct")})


CYCLES = f"""cy AS (SELECT *, (ts_ns / 1e9 - lag(ts_ns / 1e9) OVER (PARTITION BY channel, direction, is_extended, can_id ORDER BY frame_index)) * 1000 AS cycle_ms FROM fr)"""


@query("bus_overview", f"""WITH {SPAN}, {CYCLES} SELECT round(any_value(dur), 6) AS duration_s, any_value(n) AS frames, (SELECT count(DISTINCT can_id) FROM fr) AS unique_ids,
  (SELECT count(DISTINCT (channel, direction, is_extended, can_id)) FROM fr) AS unique_streams, (SELECT count(*) FROM fr WHERE is_extended) AS extended_frames,
  CAST(0 AS BIGINT) AS error_frames, CAST(0 AS BIGINT) AS remote_frames, round(any_value(n / dur), 6) AS avg_frames_per_s, round(max(fb.frames) / any_value(w), 6) AS peak_frames_per_s,
  round(sum(busy) / any_value(dur) * 100, 6) AS avg_load_pct, round(max(busy) / any_value(w) * 100, 6) AS peak_load_pct, (SELECT count(*) FROM cy WHERE cycle_ms < 0) AS negative_cycles FROM bw, fb""")
def q_bus_overview(spark, d):
    return rounded(TR.bus_overview(frames(spark, d), bin_ms=5000).drop("source_file"))


@query("top_ids", f"""WITH {FRAMES} SELECT channel, direction, 'Classic' AS frame_format, is_extended, can_id, count(*) AS frames, round(count(*) * 100.0 / (SELECT count(*) FROM fr), 6) AS share_pct,
  CAST(8 AS DOUBLE) AS mean_payload_len FROM fr GROUP BY ALL ORDER BY frames DESC, channel, can_id, direction, is_extended LIMIT 30""")
def q_top_ids(spark, d):
    return rounded(TR.top_ids(frames(spark, d)).drop("source_file"))


@query("top_ids_by_file", f"""WITH {FILES}, g AS (SELECT source_file, channel, direction, is_extended, can_id, count(*) AS frames FROM ff GROUP BY ALL),
c AS (SELECT *, sum(frames) OVER (PARTITION BY source_file) AS all_frames FROM g)
SELECT source_file, channel, direction, is_extended, can_id, frames, round(frames * 100.0 / all_frames, 6) AS share_pct FROM c
QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY frames DESC, channel, can_id, direction, is_extended) <= 7""")
def q_top_ids_by_file(spark, d):
    return rounded(TR.top_ids(file_frames(spark, d), 7).drop("frame_format", "mean_payload_len"))


@query("cycle_timing_by_file", f"""WITH {FILES}, cy AS (SELECT *, (ts_ns / 1e9 - lag(ts_ns / 1e9) OVER (PARTITION BY source_file, channel, direction, is_extended, can_id ORDER BY frame_index)) * 1000 AS cycle_ms FROM ff),
c AS (SELECT source_file, channel, direction, is_extended, can_id, count(cycle_ms) AS cycles, coalesce(stddev_samp(cycle_ms), 0) AS jitter FROM cy WHERE cycle_ms IS NOT NULL GROUP BY ALL)
SELECT source_file, channel, is_extended, can_id, cycles, round(jitter, 3) AS jitter_ms FROM c
QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY jitter DESC, cycles DESC, channel, can_id, direction, is_extended) <= 9""")
def q_cycle_timing_by_file(spark, d):
    return rounded(TR.cycle_timing(file_frames(spark, d), 9).select("source_file", "channel", "is_extended", "can_id", "cycles", "jitter_ms"), 3)


@query("cycle_times", f"WITH {FRAMES}, {CYCLES} SELECT channel, direction, is_extended, can_id, frame_index, round(cycle_ms, 3) AS cycle_ms FROM cy")
def q_cycle_times(spark, d):
    return rounded(TR.cycle_times(frames(spark, d)).select("channel", "direction", "is_extended", "can_id", "frame_index", "cycle_ms"), 3)


@query("cycle_timing", f"""WITH {FRAMES}, {CYCLES} SELECT channel, direction, 'Classic' AS frame_format, is_extended, can_id, count(cycle_ms) AS cycles, round(avg(cycle_ms), 3) AS mean_cycle_ms,
  round(coalesce(stddev_samp(cycle_ms), 0), 3) AS jitter_ms, round(min(cycle_ms), 3) AS min_cycle_ms, round(max(cycle_ms), 3) AS max_cycle_ms, count(*) FILTER (cycle_ms < 0) AS negative_cycles
FROM cy WHERE cycle_ms IS NOT NULL GROUP BY ALL ORDER BY stddev_samp(cycle_ms) DESC, cycles DESC, channel, can_id LIMIT 40""")
def q_cycle_timing(spark, d):
    return rounded(TR.cycle_timing(frames(spark, d)).drop("source_file"), 3)
