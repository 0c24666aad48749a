"""Series statistics, reduction, and functions on their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from buslens.functions.labels import count_bucket, duration_bucket
from buslens.operators import reduce as RD
from buslens.operators import series as S
from harness.registry import query, rounded
from harness.views import SAMPLES, SERIES, samples

WITH = f"WITH {SAMPLES}"


@query("deltas_slopes", WITH + """ SELECT message_name, frame_index, round(greatest(t - t0, 0), 6) AS dt, round(value - v0, 6) AS delta,
  round(CASE WHEN t > t0 THEN (value - v0) / (t - t0) END, 6) AS slope FROM sl""")
def q_deltas(spark, d):
    rows = S.deltas_slopes(samples(spark, d), SERIES)
    # greatest() ignores NULL in both engines, so a first row shows zero time passed.
    return rounded(rows.select("message_name", "frame_index", "dt", "delta", "slope"))


@query("series_order", WITH + " SELECT message_name, frame_index, pos FROM sl")
def q_series_order(spark, d):
    from buslens.operators.ordered import ordered
    o = ordered(samples(spark, d).select("message_name", "ts_ns", "frame_index"), ["message_name"], ["ts_ns", "frame_index"])
    return o.number("pos").done().select("message_name", "frame_index", "pos")


@query("signal_stats", WITH + """ SELECT message_name, count(*) AS n, round(max(t) - min(t), 6) AS duration_s, min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS mean,
  round(quantile_cont(value, 0.5), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.01), 6) AS p01, round(quantile_cont(value, 0.99), 6) AS p99,
  arg_min(value, frame_index) AS first_value, arg_max(value, frame_index) AS last_value, round(arg_max(value, frame_index) - arg_min(value, frame_index), 6) AS net_change FROM sa GROUP BY 1""")
def q_signal_stats(spark, d):
    return rounded(S.signal_stats(samples(spark, d), SERIES).drop("signal_name"))


@query("event_stats", WITH + """, st AS (SELECT message_name, pos, t, value, v0, greatest(t - t0, 0) AS dt, abs(value - v0) AS step, value >= 30 AS above, v0 >= 30 AS was FROM sl),
fl AS (SELECT *, CASE WHEN was IS DISTINCT FROM lag(was) OVER (PARTITION BY message_name ORDER BY pos) THEN 1 ELSE 0 END AS flip FROM st),
rn AS (SELECT *, sum(flip) OVER (PARTITION BY message_name ORDER BY pos) AS run FROM fl),
lr AS (SELECT message_name, max(s) AS longest FROM (SELECT message_name, run, sum(dt) AS s FROM rn WHERE was GROUP BY ALL) GROUP BY 1)
SELECT message_name, count(*) FILTER (NOT was AND above) AS rising, count(*) FILTER (was AND NOT above) AS falling, count(*) FILTER (step > 0 AND step >= 0.5) AS changes,
  round(sum(dt) FILTER (was) / sum(dt) * 100, 6) AS above_pct, round(any_value(longest), 6) AS longest_above_s, round(avg(step), 6) AS mean_abs_delta, round(quantile_cont(step, 0.95), 6) AS p95_abs_delta,
  round(max(step), 6) AS max_abs_delta, round(avg(CASE WHEN dt > 0 THEN step / dt END), 6) AS mean_abs_slope, round(max(CASE WHEN dt > 0 THEN step / dt END), 6) AS max_abs_slope,
  round(count(*) FILTER (step <= 1e-12) * 100.0 / count(*), 6) AS flat_pct FROM st JOIN lr USING (message_name) WHERE v0 IS NOT NULL GROUP BY message_name""")
def q_event_stats(spark, d):
    return rounded(S.event_stats(samples(spark, d), SERIES, threshold=30.0, change_threshold=0.5).drop("signal_name"))


def histogram_sql(source: str, key: str, value: str, n: int, low: str = "min(v)", high: str = "max(v)") -> str:
    return f"""hv AS (SELECT {key} AS k, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
hs AS (SELECT k, least(CAST({low} AS DOUBLE), min(v)) AS lo, greatest(CAST({high} AS DOUBLE), max(v)) AS hi FROM hv GROUP BY k),
hw AS (SELECT k, lo, (hi - lo) / {n} AS w FROM hs),
hc AS (SELECT k, greatest(0, least(CAST(floor((v - lo) / w) AS INT), {n - 1})) AS bin, count(*) AS c FROM hv JOIN hw USING (k) GROUP BY ALL),
hg AS (SELECT k AS {key}, bin, round(lo + bin * w, 6) AS bin_start, round(lo + bin * w + w, 6) AS bin_end, coalesce(c, 0) AS count
  FROM (SELECT k, lo, w, CAST(unnest(range({n})) AS INT) AS bin FROM hw) LEFT JOIN hc USING (k, bin))"""


@query("histogram", WITH + ", " + histogram_sql("sa", "message_name", "value", 40) + " SELECT * FROM hg")
def q_histogram(spark, d):
    return rounded(S.histogram(samples(spark, d), ["message_name"]))


@query("delta_histogram", WITH + ", dl AS (SELECT message_name, value - v0 AS delta FROM sl), " + histogram_sql("dl", "message_name", "delta", 25) + " SELECT * FROM hg")
def q_delta_histogram(spark, d):
    return rounded(S.delta_histogram(samples(spark, d), ["message_name"], bins=25))


@query("cdf", WITH + ", " + histogram_sql("sa", "message_name", "value", 40) + """ SELECT message_name, bin,
  round(sum(count) OVER (PARTITION BY message_name ORDER BY bin) * 100.0 / sum(count) OVER (PARTITION BY message_name), 6) AS cumulative_pct FROM hg""")
def q_cdf(spark, d):
    return rounded(S.cdf(S.histogram(samples(spark, d), ["message_name"]), ["message_name"]).select("message_name", "bin", "cumulative_pct"))


@query("rank_signals", WITH + """, rk AS (SELECT message_name, count(*) AS n, greatest(1e-9, max(t) - min(t)) AS duration_s, max(value) - min(value) AS value_range, stddev_pop(value) AS std,
  count(*) FILTER (abs(value - v0) >= 0.01) AS changes, max(abs(value - v0)) AS max_abs_delta, max(abs(CASE WHEN t > t0 THEN (value - v0) / (t - t0) END)) AS max_abs_slope FROM sl GROUP BY 1)
SELECT message_name, n, round(duration_s, 6) AS duration_s, round(value_range, 6) AS value_range, round(std, 6) AS std, changes, round(max_abs_delta, 6) AS max_abs_delta,
  round(max_abs_slope, 6) AS max_abs_slope, round(changes / duration_s, 6) AS changes_per_s, round(changes / duration_s * 0.6 + std * 0.25 + max_abs_slope * 0.15, 6) AS score
FROM rk ORDER BY score DESC LIMIT 3""")
def q_rank(spark, d):
    return rounded(S.rank_signals(samples(spark, d), SERIES, top_n=3).drop("signal_name"))


@query("interval_stats", WITH + """ SELECT message_name, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, round(max(t - t0), 6) AS max_dt,
  count(*) FILTER (t = t0) AS dup_dt, round(quantile_cont(CASE WHEN t > t0 THEN t - t0 END, 0.5), 6) AS median_dt FROM sl GROUP BY 1""")
def q_intervals(spark, d):
    return rounded(S.interval_stats(samples(spark, d), SERIES).drop("signal_name"))


@query("slice_time", WITH + " SELECT message_name, frame_index, value FROM sa WHERE t BETWEEN 250000.5 AND 1500000.25")
def q_slice(spark, d):
    return S.slice_time(samples(spark, d), 1500000.25, 250000.5).select("message_name", "frame_index", "value")


@query("slice_or_full", WITH + """, c AS (SELECT message_name, max(value > 250 AND t <= 500000) AS hit FROM sa GROUP BY 1),
f AS (SELECT * FROM sa WHERE value > 250) SELECT message_name, frame_index FROM f SEMI JOIN c USING (message_name) WHERE t <= 500000
  OR message_name NOT IN (SELECT message_name FROM f WHERE t <= 500000)""")
def q_slice_or_full(spark, d):
    rows = samples(spark, d).where("value > 250")
    return S.slice_time(rows, None, 500000, keys=["message_name"], full_if_empty=True).select("message_name", "frame_index")


@query("choose_resolution", WITH + " SELECT message_name, count(*) AS visible, count(*) > 100 AS must_reduce FROM sa WHERE t >= 100000 AND t <= 400000.5 GROUP BY 1")
def q_resolution(spark, d):
    return S.choose_resolution(samples(spark, d), ["message_name"], start=100000, end=400000.5, limit=100)


@query("transform_series", WITH + """, o AS (SELECT *, value + CASE WHEN message_name = 'error' THEN 100.5 WHEN message_name = 'click' THEN -3 ELSE 0 END AS y FROM sa WHERE t >= 100000),
m AS (SELECT message_name, min(y) AS lo, max(y) AS hi FROM o GROUP BY 1) SELECT message_name, frame_index, round((y - lo) / (hi - lo), 6) AS value FROM o JOIN m USING (message_name)""")
def q_transform(spark, d):
    rows = samples(spark, d)
    offsets = spark.createDataFrame([("error", 100.5), ("click", -3.0)], "message_name string, offset double")
    return rounded(S.transform_series(rows, ["message_name"], offsets=offsets, normalize=True, start=100000).select("message_name", "frame_index", "value"))


@query("robust_normalize", WITH + """, q AS (SELECT message_name, (quantile_cont(value, 0.01) + quantile_cont(value, 0.99)) * 0.5 AS c,
  greatest(1e-9, (quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) * 0.5) AS s FROM sa GROUP BY 1)
SELECT message_name, frame_index, round(greatest(-1.2, least(1.2, (value - c) / s)), 6) AS norm FROM sa JOIN q USING (message_name)""")
def q_normalize(spark, d):
    return rounded(S.robust_normalize(samples(spark, d), ["message_name"], limit=1.2).select("message_name", "frame_index", "norm"))


@query("scale_to_reference", WITH + """, q AS (SELECT message_name, (quantile_cont(value, 0.01) + quantile_cont(value, 0.99)) * 0.5 AS c,
  greatest(1e-9, (quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) * 0.5) AS s, (quantile_cont(value * value, 0.01) + quantile_cont(value * value, 0.99)) * 0.5 AS rc,
  greatest(1e-9, (quantile_cont(value * value, 0.99) - quantile_cont(value * value, 0.01)) * 0.5) AS rs FROM sa GROUP BY 1)
SELECT message_name, frame_index, round(rc - (value - c) / s * rs, 5) AS scaled FROM sa JOIN q USING (message_name)""")
def q_scale(spark, d):
    rows = samples(spark, d)
    out = S.scale_to_reference(rows, rows.withColumn("value", F.col("value") * F.col("value")), ["message_name"], invert=True)
    return rounded(out.select("message_name", "frame_index", "scaled"), 5)


@query("downsample_minmax", WITH + """, b AS (SELECT *, len / CAST(50 AS DOUBLE) AS w, CAST(floor(pos / (len / CAST(50 AS DOUBLE))) AS BIGINT) AS g FROM sl),
k AS (SELECT *, least(49, CASE WHEN floor((g + 1) * w) <= pos THEN g + 1 WHEN floor(g * w) > pos THEN g - 1 ELSE g END) AS bucket FROM b),
p AS (SELECT message_name, bucket, first(pos ORDER BY value, pos) AS lo, first(pos ORDER BY value DESC, pos) AS hi FROM k GROUP BY ALL),
u AS (SELECT message_name, lo AS pos FROM p UNION ALL SELECT message_name, hi FROM p)
SELECT u.message_name, u.pos, sl.frame_index, sl.value FROM u JOIN sl ON sl.message_name = u.message_name AND sl.pos = u.pos""")
def q_downsample(spark, d):
    return RD.downsample_minmax(samples(spark, d), ["message_name"], 100).select("message_name", "pos", "frame_index", "value")


@query("stride_reduce", WITH + " SELECT message_name, pos, frame_index FROM sl WHERE pos % CAST(ceil(len / CAST(100 AS DOUBLE)) AS BIGINT) = 0 OR pos = len - 1")
def q_stride(spark, d):
    return RD.stride_reduce(samples(spark, d), ["message_name"], 100).select("message_name", "pos", "frame_index")


@query("runs_above", WITH + """, st AS (SELECT message_name, pos, greatest(t - t0, 0) AS dt, v0 >= 30 AS was FROM sl),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY message_name, was ORDER BY pos) AS grp FROM st)
SELECT message_name, round(max(s), 6) AS longest_above_s FROM (SELECT message_name, grp, sum(dt) AS s FROM g WHERE was GROUP BY ALL) GROUP BY 1""")
def q_runs(spark, d):
    return rounded(S.event_stats(samples(spark, d), ["message_name"], threshold=30.0).select("message_name", "longest_above_s"))


@query("buckets", """SELECT o_orderkey, CASE WHEN o_custkey <= 0 THEN '0' WHEN o_custkey <= 10 THEN '1-10' WHEN o_custkey <= 100 THEN '11-100' WHEN o_custkey <= 1000 THEN '101-1k' ELSE '1k-10k' END AS count_class,
  CASE WHEN o_totalprice < 1000 THEN '<1s' WHEN o_totalprice < 5000 THEN '1s-5s' WHEN o_totalprice < 15000 THEN '5s-15s' WHEN o_totalprice < 60000 THEN '15s-1m' WHEN o_totalprice < 300000 THEN '1m-5m'
   WHEN o_totalprice < 900000 THEN '5m-15m' ELSE '15m+' END AS duration_class FROM orders""")
def q_buckets(spark, d):
    from harness.views import table
    return table(spark, d, "orders").select("o_orderkey", count_bucket(F.col("o_custkey")).alias("count_class"),
                                            duration_bucket(F.col("o_totalprice")).alias("duration_class"))


@query("smoothed_derivative", WITH + """, x AS (SELECT message_name, pos AS i, len AS points, CASE WHEN pos = 0 THEN 0 ELSE (value - v0) / 0.5 END AS d FROM sl),
y AS (SELECT *, lag(d) OVER w AS d0, lead(d) OVER w AS d1 FROM x WINDOW w AS (PARTITION BY message_name ORDER BY i))
SELECT message_name, i, round(CASE WHEN i = 0 OR i = points - 1 THEN d ELSE (d0 + d + d1) / 3 END, 6) AS slope FROM y""")
def q_smoothed(spark, d):
    from buslens.operators.delay import smoothed_derivative
    from buslens.operators.ordered import ordered
    o = ordered(samples(spark, d), ["message_name"], ["ts_ns", "frame_index"]).number("i", "points")
    return rounded(smoothed_derivative(o, "value", "slope", F.lit(0.5)).done().select("message_name", "i", "slope"))


@query("analyze_signals", WITH + """ SELECT message_name, count(*) AS n, round(avg(value), 6) AS mean, count(*) FILTER (v0 < 20 AND value >= 20) AS rising,
  count(*) FILTER (v0 >= 20 AND value < 20) AS falling, CAST(40 AS BIGINT) AS bins, count(v0) AS deltas FROM sl GROUP BY 1""")
def q_analyze_signals(spark, d):
    out = S.analyze_signals(samples(spark, d), ["message_name"], threshold=20.0)
    bins = out.histogram.groupBy("message_name").agg(F.count(F.lit(1)).alias("bins"))
    deltas = out.delta_histogram.groupBy("message_name").agg(F.sum("count").alias("deltas"))
    rows = out.stats.select("message_name", "n", "mean").join(out.events.select("message_name", "rising", "falling"), "message_name")
    return rounded(rows.join(bins, "message_name").join(deltas, "message_name"))
