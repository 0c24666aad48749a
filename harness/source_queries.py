"""Reading text recordings and catalogs, and their accounting."""

from __future__ import annotations

from pyspark.sql import functions as F

from buslens.functions.frame import with_frame_projections
from buslens.operators.catalog import bit_layout, dbc_conflicts, dbc_overlap, layout_issues
from buslens.plans.dataset import dataset_overview, load_dataset, with_provenance
from buslens.plans.staging import new_path
from buslens.sources.detect import detect_format
from buslens.sources.dbc import load_dbc
from buslens.sources.provenance import file_digests
from buslens.sources.readers import read_log
from harness.registry import query, rounded
from harness.views import (EXT_ID, FRAMES, LINES, ORDER_BITS, RECORDING, can_id, candump_logs, events, hex_payload, log_glob,
                           order_catalog, recording, recording_name, write_log)

FRAME_VIEW = ["frame_index", "source_line", "ts_ns", "can_id", "is_extended", "dlc", "payload_hex", "frame_type", "channel",
              "frame_format", "direction"]


def frame_view(frames):
    return frames.select(recording().alias("recording"), F.hex("payload").alias("payload_hex"), *[c for c in FRAME_VIEW if c != "payload_hex"])


def expected(time, ext="is_extended", frame_type="''", channel="''", direction="'Unknown'"):
    return f"""SELECT recording, frame_no AS frame_index, line_no AS source_line, {time} AS ts_ns, can_id, {ext} AS is_extended,
  CAST(8 AS INT) AS dlc, data_hex AS payload_hex, {frame_type} AS frame_type, {channel} AS channel, 'Classic' AS frame_format,
  {direction} AS direction FROM ok"""


@query("read_candump", f"WITH {LINES} " + expected("rel_ns", channel="channel"))
def q_read_candump(spark, d):
    return frame_view(read_log(spark, log_glob(candump_logs(spark, d)), "candump").frames)


@query("number_lines", f"WITH {LINES} SELECT recording, line_no AS source_line, event_id FROM ok")
def q_number_lines(spark, d):
    frames = read_log(spark, log_glob(candump_logs(spark, d)), "candump").frames
    number = F.conv(F.substring(F.hex("payload"), 1, 12), 16, 10).cast("bigint")
    return frames.select(recording().alias("recording"), "source_line", number.alias("event_id"))


@query("import_report", f"""WITH {LINES} SELECT recording, 'candump' AS parser, count(*) AS total, count(*) FILTER (line_class = 'non_data') AS non_data,
  count(*) FILTER (line_class = 'accepted') AS accepted, count(*) FILTER (line_class = 'rejected') AS rejected,
  CASE WHEN count(*) FILTER (line_class = 'rejected') > 0 THEN 'Partial' ELSE 'Complete' END AS completeness FROM ln GROUP BY recording""")
def q_import_report(spark, d):
    report = read_log(spark, log_glob(candump_logs(spark, d)), "candump").report
    return report.withColumn("recording", recording()).drop("source_file")


@query("classify_lines", f"""WITH {LINES} SELECT recording, line_no AS source_line, 'Error' AS severity, 'CANDUMP_SYNTAX' AS code, 'corrupt line' AS line_text
  FROM ln WHERE line_class = 'rejected'""")
def q_classify_lines(spark, d):
    issues = read_log(spark, log_glob(candump_logs(spark, d)), "candump").issues
    return issues.select(recording().alias("recording"), "source_line", "severity", "code", "line_text")


def spaced_bytes():
    return F.rtrim(F.regexp_replace(hex_payload(), "(..)", "$1 "))


def clock(sep):
    return F.concat(F.date_format(F.col("ts").cast("timestamp"), "HH:mm:ss"), F.lit(sep), F.lpad(((F.floor(F.col("ts_ns") / 1000)) % 1_000_000).cast("string"), 6, "0"))


@query("read_busmaster", f"""WITH {LINES},
cl AS (SELECT *, ts_ns % 86400000000000 AS tod, lag(ts_ns % 86400000000000) OVER (PARTITION BY recording ORDER BY event_id) AS prev
  FROM ln WHERE line_class = 'accepted'),
dy AS (SELECT *, sum(CASE WHEN prev - tod > 43200000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY recording ORDER BY event_id) AS days,
  row_number() OVER (PARTITION BY recording ORDER BY event_id) - 1 AS frame_no, first_value(tod) OVER (PARTITION BY recording ORDER BY event_id) AS base FROM cl),
ok2 AS (SELECT * FROM dy)
""" + expected("CAST(days * 86400000000000 + tod - base AS BIGINT)", frame_type="frame_type", channel="channel", direction="direction").replace("FROM ok", "FROM ok2"))
def q_read_busmaster(spark, d):
    good = F.concat_ws(" ", clock(":"), F.when(F.col("event_type") == "purchase", "Tx").otherwise("Rx"),
                       F.concat(F.lit("can"), (F.col("event_id") % 2).cast("string")), F.concat(F.lit("0x"), F.hex(can_id())),
                       F.when(F.col("user_id") % 5 == 0, "x").otherwise("s"), F.lit("8"), spaced_bytes())
    line = F.when(F.col("event_id") % 100 == 7, "corrupt line").when(F.col("event_id") % 250 == 3, "*** comment").otherwise(good)
    path = write_log(spark, events(spark, d), line)
    return frame_view(read_log(spark, log_glob(path), "busmaster").frames)


@query("read_peak_trc", f"WITH {LINES} " + expected("ts_ns", frame_type="frame_type", direction="direction"))
def q_read_peak(spark, d):
    us = F.floor(F.col("ts_ns") / 1000)
    time = F.format_string("%d.%03d", F.floor(us / 1000), us % 1000)
    way = F.when(F.col("event_type") == "purchase", "Tx").otherwise("Rx")
    classic = F.concat_ws(" ", F.concat((F.col("event_id") + 1).cast("string"), F.lit(")")), time, way, F.hex(can_id()), F.lit("8"), spaced_bytes())
    line = F.when(F.col("event_id") % 100 == 7, "corrupt line").when(F.col("event_id") % 250 == 3, "; comment").otherwise(classic)
    path = write_log(spark, events(spark, d), line)
    return frame_view(read_log(spark, log_glob(path), "peak").frames)


@query("read_css", f"""WITH {LINES}, ms AS (SELECT * REPLACE ((ts_ns // 1000000) * 1000000 AS ts_ns), line_no + 1 AS shifted FROM ok),
hd AS (SELECT *, ts_ns - first_value(ts_ns) OVER (PARTITION BY recording ORDER BY event_id) AS rel2 FROM ms)
""" + expected("rel2", frame_type="CASE WHEN is_extended THEN 'Ext' ELSE 'Std' END").replace("FROM ok", "FROM hd"))
def q_read_css(spark, d):
    day = F.floor(F.col("ts_ns") / 86_400_000_000_000) + 1
    stamp = F.concat(F.lpad(day.cast("string"), 2, "0"), F.lit("T"), F.date_format(F.col("ts").cast("timestamp"), "HHmmssSSS"))
    good = F.concat_ws(";", stamp, F.when(F.col("user_id") % 5 == 0, "1").otherwise("0"), F.hex(can_id()), hex_payload())
    line = F.when(F.col("event_id") % 100 == 7, "corrupt line").when(F.col("event_id") % 250 == 3, "# comment").otherwise(good)
    rows = events(spark, d).withColumn("line", line)
    rows = rows.withColumn("name", recording_name())
    starts = rows.groupBy("name").agg(F.min("event_id").alias("first_id"))
    rows = rows.join(starts, "name").withColumn("first", F.col("event_id") == F.col("first_id"))
    # The header stands on the first line of a recording, as a second text line of its row.
    rows = rows.withColumn("line", F.when(F.col("first"), F.concat(F.lit("Timestamp;Type;ID;Data\n"), F.col("line"))).otherwise(F.col("line")))
    path = write_log(spark, rows, F.col("line"))
    frames = read_log(spark, log_glob(path), "css").frames
    return frame_view(frames.withColumn("source_line", F.col("source_line") - 1))


@query("read_generic", f"WITH {LINES} " + expected("ts_ns", frame_type="frame_type", direction="direction", ext="can_id > 2047"))
def q_read_generic(spark, d):
    us = F.floor(F.col("ts_ns") / 1000)
    time = F.format_string("%d.%06d", F.floor(us / 1_000_000), us % 1_000_000)
    good = F.concat_ws("  ", time, F.when(F.col("event_type") == "purchase", "Tx").otherwise("Rx"),
                       F.concat(F.lit("0x"), F.hex(can_id())), F.lit("8"), spaced_bytes())
    line = F.when(F.col("event_id") % 100 == 7, "corrupt line").when(F.col("event_id") % 250 == 3, "// comment").otherwise(good)
    path = write_log(spark, events(spark, d), line)
    return frame_view(read_log(spark, log_glob(path), "generic").frames)


@query("detect_format", f"""WITH {LINES}, hd AS (SELECT * FROM ln WHERE line_no <= 200)
SELECT recording, CAST(least(100, 20 * count(*) FILTER (line_class = 'accepted')) AS BIGINT) AS candump, CAST(0 AS BIGINT) AS busmaster,
  CAST(0 AS BIGINT) AS peak, CAST(0 AS BIGINT) AS css, 'candump' AS format, 'ok' AS status FROM hd GROUP BY recording""")
def q_detect_format(spark, d):
    found = detect_format(spark, log_glob(candump_logs(spark, d)))
    return found.select(recording().alias("recording"), *[F.col(c).cast("bigint").alias(c) for c in ("candump", "busmaster", "peak", "css")], "format", "status")


LOG_TEXT = LINES + """, tx AS (SELECT recording, event_id, CASE line_class WHEN 'rejected' THEN 'corrupt line' WHEN 'non_data' THEN '# comment'
  ELSE printf('(%d.%06d) %s %X#%s', (ts_ns // 1000) // 1000000, (ts_ns // 1000) % 1000000, channel, can_id, data_hex) END AS value FROM ln),
js AS (SELECT recording, string_agg(value, chr(10) ORDER BY event_id) || chr(10) AS body FROM tx GROUP BY recording)"""


@query("file_digests", f"WITH {LOG_TEXT} SELECT recording, CAST(strlen(body) AS BIGINT) AS bytes, upper(sha256(body)) AS sha256 FROM js")
def q_file_digests(spark, d):
    return file_digests(spark, log_glob(candump_logs(spark, d))).select(recording().alias("recording"), "bytes", "sha256")


def dbc_text(spark, d) -> str:
    """The order catalog as catalog text: one line per message and signal, written in order."""
    cat = order_catalog(spark, d)
    head = cat.messages.select("msg_order", F.lit(0).alias("sig_order"), F.concat(
        F.lit("BO_ "), F.col("msg_order").cast("string"), F.lit(" "), "name", F.lit(": 8 Node")).alias("value"))
    mux = F.when(F.col("is_mux"), " M").when(F.size("mux_ids") > 0, F.concat(F.lit(" m"), F.get("mux_ids", F.lit(0)).cast("string"))).otherwise("")
    body = cat.signals.select("msg_order", "sig_order", F.concat(
        F.lit(" SG_ "), "name", mux, F.format_string(" : %d|%d@%d+ (1,0) [0|0] \"\" Node", "start_bit", "length", F.col("little_endian").cast("int"))).alias("value"))
    path = new_path(spark, "dbc")
    # A message and its signals stay in one file.
    rows = head.unionByName(body).withColumn("file", F.floor(F.col("msg_order") / 10_000))
    rows.repartition("file").sortWithinPartitions("file", "msg_order", "sig_order").select("value").write.text(path)
    return path


@query("load_dbc", f"""WITH {ORDER_BITS} SELECT CAST(msg_order AS BIGINT) AS raw_frame_id, 'Order' || CAST(msg_order AS VARCHAR) AS message, name, start_bit, length,
  intel AS little_endian, is_mux, CASE WHEN NOT is_mux THEN mux_id END AS mux_id FROM sg""")
def q_load_dbc(spark, d):
    cat = load_dbc(spark, dbc_text(spark, d))
    ids = cat.messages.select("msg_order", "raw_frame_id", F.col("name").alias("message"))
    return cat.signals.join(ids, "msg_order").select("raw_frame_id", "message", "name", "start_bit", "length", "little_endian", "is_mux",
                                                     F.get("mux_ids", F.lit(0)).alias("mux_id"))


TOGETHER = "(a.is_mux OR b.is_mux OR a.mux_id IS NULL OR b.mux_id IS NULL OR a.mux_id = b.mux_id)"
OVERLAPS = f"""ov AS (SELECT a.msg_order, a.sig_order AS left_order, a.name AS left_name, b.sig_order AS right_order, b.name AS right_name,
  count(*) AS shared_bits FROM bits a JOIN bits b ON a.msg_order = b.msg_order AND a.bit = b.bit AND a.sig_order < b.sig_order AND {TOGETHER} GROUP BY ALL)"""


@query("dbc_overlap", f"WITH {ORDER_BITS}, {OVERLAPS} SELECT * FROM ov")
def q_dbc_overlap(spark, d):
    return dbc_overlap(order_catalog(spark, d))


@query("layout_issues", f"""WITH {ORDER_BITS}, {OVERLAPS} SELECT DISTINCT msg_order FROM (SELECT msg_order FROM ov UNION ALL SELECT msg_order FROM bits WHERE bit >= 64)""")
def q_layout_issues(spark, d):
    return layout_issues(order_catalog(spark, d)).select("msg_order")


@query("bit_layout", f"""WITH {ORDER_BITS}, b AS (SELECT msg_order, bit, count(*) AS claims, arg_min(name, sig_order) AS first_owner FROM bits WHERE bit BETWEEN 0 AND 63 GROUP BY ALL)
SELECT msg_order, bit, CASE WHEN claims > 1 THEN 'OVERLAP' ELSE first_owner END AS owner, claims > 1 AS is_overlap FROM b""")
def q_bit_layout(spark, d):
    return bit_layout(order_catalog(spark, d))


@query("dbc_conflicts", f"""WITH {ORDER_BITS}, b AS (SELECT msg_order, bit, count(*) AS n FROM bits GROUP BY ALL),
c AS (SELECT msg_order, sum(CASE WHEN bit < 64 THEN n - 1 ELSE 0 END) AS ov, sum(CASE WHEN bit > 63 THEN n ELSE 0 END) AS bp FROM b GROUP BY ALL)
SELECT CAST(o_orderkey AS INT) AS msg_order, CAST(coalesce(ov, 0) AS BIGINT) AS overlap_bits, CAST(0 AS BIGINT) AS bits_beyond_dlc,
  CAST(coalesce(bp, 0) AS BIGINT) AS bits_beyond_payload, CAST(0 AS BIGINT) AS unnamed_signals, count(*) OVER (PARTITION BY o_orderkey % 2048) > 1 AS id_shared
FROM orders LEFT JOIN c ON msg_order = o_orderkey""")
def q_dbc_conflicts(spark, d):
    return dbc_conflicts(order_catalog(spark, d)).drop("name", "is_extended", "frame_id")


@query("frame_projections", f"""WITH {FRAMES} SELECT frame_index, ts_ns / 1e9 AS time_s, '0x' || printf('%X', can_id) AS id_hex,
  trim(regexp_replace(data_hex, '(..)', '\\1 ', 'g')) AS data_hex, CASE WHEN is_extended THEN 'CAN/Ext' ELSE 'CAN/Std' END AS message_type,
  channel AS channel_text, frame_type AS direction_text FROM fr""")
def q_frame_projections(spark, d):
    from harness.views import frames
    return with_frame_projections(frames(spark, d)).select("frame_index", "time_s", "id_hex", "data_hex", "message_type", "channel_text", "direction_text")


DBC = "BO_ %d Msg%d: 8 Node\n SG_ EventId : 7|48@0+ (1,0) [0|0] \"\" Node\n SG_ Value : 55|16@0+ (0.01,0) [0|0] \"V\" Node"


def frame_catalog_text(spark, d) -> str:
    """Catalog text with one message per id that occurs in the events."""
    raw = F.when(F.col("can_id") > 2047, F.col("can_id") + 0x80000000).otherwise(F.col("can_id"))
    ids = events(spark, d).select(can_id().alias("can_id")).distinct().where((F.col("can_id") < 280) | (F.col("can_id") == EXT_ID))
    path = new_path(spark, "dbc")
    ids.repartition(1).sortWithinPartitions("can_id").select(F.format_string(DBC, raw, F.col("can_id")).alias("value")).write.text(path)
    return path


def loaded(spark, d):
    return load_dataset(spark, log_glob(candump_logs(spark, d)), frame_catalog_text(spark, d), mode="Partial", fmt="candump")


KNOWN = f"(can_id < 280 OR (is_extended AND can_id <= {EXT_ID} + 31))"
DATASET = LINES + f""", dd AS (SELECT *, CASE WHEN {KNOWN} THEN CASE WHEN is_extended THEN {EXT_ID} ELSE can_id END END AS msg FROM ok)"""


@query("load_dataset", f"""WITH {DATASET} SELECT recording, frame_no AS frame_index, line_no AS source_line, rel_ns AS ts_ns, 'Msg' || CAST(msg AS VARCHAR) AS message_name,
  signal_name, round(CASE signal_name WHEN 'EventId' THEN event_id ELSE round(ev_value * 100) * 0.01 END, 6) AS value, 'PartialDataset' AS quality
FROM dd, (VALUES ('EventId'), ('Value')) v(signal_name) WHERE msg IS NOT NULL""")
def q_load_dataset(spark, d):
    s = loaded(spark, d).samples
    return rounded(s.select(recording().alias("recording"), "frame_index", "source_line", "ts_ns", "message_name", "signal_name", "value", "quality"))


@query("dataset_overview", f"""WITH {DATASET} SELECT count(*) AS frames, count(DISTINCT can_id) AS unique_ids, count(msg) AS decoded_frames,
  count(*) FILTER (msg IS NULL) AS unmatched_frames, 2 * count(msg) AS samples,
  2 * count(DISTINCT (recording, channel, is_extended, can_id)) FILTER (msg IS NOT NULL) AS signals,
  count(DISTINCT (can_id, msg)) FILTER (msg IS NOT NULL) AS messages, count(*) FILTER (is_extended) AS extended_frames, 'Partial' AS completeness FROM dd""")
def q_dataset_overview(spark, d):
    return dataset_overview(loaded(spark, d)).select("frames", "unique_ids", "decoded_frames", "unmatched_frames", "samples", "signals",
                                                     "messages", "extended_frames", "completeness")


@query("union_issues", f"WITH {LINES} SELECT 'CANDUMP_SYNTAX' AS code, count(*) AS issues FROM ln WHERE line_class = 'rejected'")
def q_union_issues(spark, d):
    return loaded(spark, d).issues.groupBy("code").agg(F.count(F.lit(1)).alias("issues"))


@query("with_provenance", f"WITH {LOG_TEXT} SELECT recording, upper(sha256(body)) AS source_log_sha256, 'Partial' AS import_mode, 'Partial' AS completeness FROM js")
def q_with_provenance(spark, d):
    return with_provenance(loaded(spark, d)).where(F.length("dbc_sha256") == 64).select(
        recording().alias("recording"), "source_log_sha256", "import_mode", "completeness")
