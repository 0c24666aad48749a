"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from harness import QUERIES

HEADLINE = [
    "log_to_watch", "read_candump", "read_busmaster", "read_peak_trc", "read_css", "import_report", "decode_signals", "decode_mux", "message_summary",
    "decode_diagnostics", "filter_frames_combined", "page_frames", "message_window", "signal_watch", "bus_overview", "bus_trend", "top_ids", "cycle_timing",
    "signal_stats", "event_stats", "histogram", "rank_signals", "downsample_minmax", "transform_series", "align_pair", "alignment_report", "pair_stats",
    "axis_tracking", "nearest_sample", "next_change", "lag_curve", "edge_events", "match_edges", "first_response", "analyze_delay", "butterfly",
    "validate_events", "ingest_events", "telemetry_by_event", "dbc_overlap", "export_decoded",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One untimed run on the smallest tables loads the classes.
    QUERIES["log_to_watch"](spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
