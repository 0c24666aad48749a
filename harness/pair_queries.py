"""Alignment of pairs and the analyses built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from buslens.functions.labels import sensitivity_advice
from buslens.operators import align as A
from buslens.operators import delay as DL
from buslens.operators import edges as E
from buslens.operators import pairs as P
from buslens.operators.ordered import ordered
from buslens.operators.suggest import suggest_signals
from buslens.sources.refs import resolve_refs, signal_refs
from harness.registry import query, rounded
from harness.series_queries import histogram_sql
from harness.views import ALIGNED, SAMPLES, STEPS, events, pair_samples, samples, step_samples, table

KEY = ["pair_id"]


@query("align_pair", f'WITH {ALIGNED} SELECT pair_id, ts_ns, round("left", 6) AS "left", round("right", 6) AS "right" FROM al')
def q_align(spark, d):
    return rounded(A.align_pairs(pair_samples(spark, d), KEY).rows.select("pair_id", "ts_ns", "left", "right"))


@query("alignment_report", f"""WITH {ALIGNED}, dt AS (SELECT pair_id, side, ts_ns / 1e9 - lag(ts_ns / 1e9) OVER (PARTITION BY pair_id, side ORDER BY ts_ns) AS dt FROM ps),
md AS (SELECT pair_id, max(m) AS slow, max(x) AS worst FROM (SELECT pair_id, side, quantile_cont(dt, 0.5) AS m, max(dt) AS x FROM dt GROUP BY ALL) GROUP BY pair_id),
n AS (SELECT pair_id, count(*) AS source_rows FROM ps GROUP BY 1),
c AS (SELECT pair_id, count(*) AS times, count(*) FILTER (gap <= 5 * slow) AS covered FROM al0 JOIN md USING (pair_id) GROUP BY 1)
SELECT pair_id, CASE WHEN worst > 5 * slow THEN 'GapExceeded' ELSE 'Valid' END AS status, source_rows, CASE WHEN worst > 5 * slow THEN covered ELSE times END AS aligned_rows,
  e - s AS overlap_ns, round(covered * 100.0 / times, 6) AS coverage_pct, round(worst, 6) AS max_sample_distance_s, CAST(0 AS BIGINT) AS duplicate_intervals
FROM md JOIN n USING (pair_id) JOIN c USING (pair_id) JOIN bo USING (pair_id)""")
def q_report(spark, d):
    return rounded(A.align_pairs(pair_samples(spark, d), KEY).report.drop("note"))


@query("union_times", f"WITH {ALIGNED} SELECT pair_id, ts_ns FROM tm")
def q_union_times(spark, d):
    return A.union_times(pair_samples(spark, d), KEY)


def pair_stats_sql(source: str, key: str = "pair_id") -> str:
    """Statistics ps_out and points pp of aligned rows (key, t, x0, y0)."""
    return f"""qc AS (SELECT {key}, quantile_cont(x0, 0.5) AS cx, quantile_cont(y0, 0.5) AS cy, greatest(1e-9, greatest(quantile_cont(x0, 0.99) - quantile_cont(x0, 0.01),
  quantile_cont(y0, 0.99) - quantile_cont(y0, 0.01)) / 2) AS s FROM {source} GROUP BY 1),
pp AS (SELECT {key}, t, (x0 - cx) / s AS x, (y0 - cy) / s AS y, sqrt(((x0 - cx) / s) * ((x0 - cx) / s) + ((y0 - cy) / s) * ((y0 - cy) / s)) AS radius, cx, cy FROM {source} JOIN qc USING ({key})),
pw AS (SELECT *, coalesce(lead(t) OVER w - t, 0) AS wt, t - lag(t) OVER w AS dt, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS len
  FROM pp WINDOW w AS (PARTITION BY {key} ORDER BY t)),
ps_out AS (SELECT {key}, count(*) AS n, round(max(t) - min(t), 6) AS duration_s, round(any_value(cx), 6) AS center_x, round(any_value(cy), 6) AS center_y, round(sum(radius * wt) / sum(wt), 6) AS mean_radius,
  round(max(radius), 6) AS max_radius, round(coalesce(sum(wt) FILTER (radius <= 0.1), 0) / sum(wt) * 100, 6) AS deadzone_pct, round(coalesce(sum(wt) FILTER (radius >= 0.9), 0) / sum(wt) * 100, 6) AS saturation_pct,
  round(sum(x * wt) / sum(wt), 6) AS bias_x, round(sum(y * wt) / sum(wt), 6) AS bias_y, round(coalesce(sum(wt) FILTER (x >= 0 AND y >= 0), 0) / sum(wt) * 100, 6) AS quadrant1_pct,
  round(coalesce(sum(wt) FILTER (x < 0 AND y >= 0), 0) / sum(wt) * 100, 6) AS quadrant2_pct, round(coalesce(sum(wt) FILTER (x < 0 AND y < 0), 0) / sum(wt) * 100, 6) AS quadrant3_pct,
  round(coalesce(sum(wt) FILTER (x >= 0 AND y < 0), 0) / sum(wt) * 100, 6) AS quadrant4_pct, round(sum(len), 4) AS path_length, round(max(CASE WHEN dt > 0 THEN len / dt END), 4) AS max_speed,
  round(quantile_cont(radius, 0.95), 6) AS p95_radius, round(least(100, (quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) / 2 * 100), 6) AS used_x_range_pct,
  round(least(100, (quantile_cont(y, 0.95) - quantile_cont(y, 0.05)) / 2 * 100), 6) AS used_y_range_pct FROM pw GROUP BY {key})"""


def stats_view(stats):
    return rounded(rounded(stats.withColumns({c: F.round(c, 4) for c in ("path_length", "max_speed")})))


POINTS = ALIGNED + ', src AS (SELECT pair_id, t, "left" AS x0, "right" AS y0 FROM al)'


@query("pair_stats", f"WITH {POINTS}, {pair_stats_sql('src')} SELECT * FROM ps_out")
def q_pair_stats(spark, d):
    return stats_view(P.analyze_pairs(pair_samples(spark, d), KEY).stats)


@query("radius_histogram", f"WITH {POINTS}, {pair_stats_sql('src')}, {histogram_sql('pp', 'pair_id', 'radius', 30, low='0')} SELECT * FROM hg")
def q_radius_histogram(spark, d):
    return rounded(P.analyze_pairs(pair_samples(spark, d), KEY).radius_histogram)


@query("density_grid", f"""WITH {POINTS}, {pair_stats_sql('src')} SELECT pair_id, CAST(trunc(least(greatest((x + 1.2) / 2.4 * 64, 0), 63)) AS INT) AS bx,
  CAST(trunc(least(greatest((y + 1.2) / 2.4 * 64, 0), 63)) AS INT) AS by, count(*) AS points, round(sqrt(count(*)), 6) AS shade FROM pp GROUP BY ALL""")
def q_density(spark, d):
    return rounded(P.density_grid(P.analyze_pairs(pair_samples(spark, d), KEY).path, KEY))


WINDOWED = pair_stats_sql("src").replace("qc AS", "q1 AS").replace("JOIN qc", "JOIN q1").replace("pp AS", "p1 AS").split("pw AS")[0] + \
    "src2 AS (SELECT pair_id, t, x AS x0, y AS y0 FROM p1 WHERE t BETWEEN 2.5 AND 9.75), " + pair_stats_sql("src2")


@query("joystick_usage", f"WITH {POINTS}, {WINDOWED} SELECT * FROM ps_out")
def q_usage(spark, d):
    return stats_view(P.joystick_usage(pair_samples(spark, d), KEY, start=9.75, end=2.5).stats)


@query("sensitivity_advice", f"""WITH {POINTS}, {pair_stats_sql('src')}, a AS (SELECT pair_id, concat_ws('; ', CASE WHEN used_x_range_pct < 45 OR used_y_range_pct < 45 THEN 'range barely used: raise sensitivity or expo' END,
  CASE WHEN deadzone_pct > 40 THEN 'long dwell in deadzone: reduce deadzone or raise gain' END, CASE WHEN saturation_pct > 15 THEN 'often at end stop: lower sensitivity or limit output' END,
  CASE WHEN abs(bias_x) > 0.15 OR abs(bias_y) > 0.15 THEN 'centre offset: calibrate' END) AS advice FROM ps_out)
SELECT pair_id, CASE WHEN advice = '' THEN 'settings look healthy' ELSE advice END AS advice FROM a""")
def q_advice(spark, d):
    return P.analyze_pairs(pair_samples(spark, d), KEY).stats.select("pair_id", sensitivity_advice().alias("advice"))


def axis_sql(source: str, key: str) -> str:
    """Tracking statistics of aligned rows (key, c0, r0)."""
    return f"""aq AS (SELECT {key}, quantile_cont(c0, 0.5) AS mid, greatest(1e-9, (quantile_cont(c0, 0.99) - quantile_cont(c0, 0.01)) / 2) AS half FROM {source} GROUP BY ALL),
an AS (SELECT {key}, (c0 - mid) / half AS c, (r0 - mid) / half AS r FROM {source} JOIN aq USING ({key})),
ax AS (SELECT {key}, count(*) AS n, round(corr(c, r), 6) AS correlation, round(sqrt(avg((r - c) * (r - c))), 6) AS rmse, round(regr_slope(r, c), 6) AS gain, round(regr_intercept(r, c), 6) AS "offset",
  round(avg(abs(r - c)), 6) AS mean_abs_error, round(max(abs(r - c)), 6) AS max_abs_error, round(count(*) FILTER (abs(c) <= 0.1 AND abs(r) > 0.1) * 100.0 / count(*), 6) AS deadzone_mismatch_pct,
  round(quantile_cont(abs(r - c), 0.95), 6) AS p95_abs_error FROM an GROUP BY ALL)"""


@query("axis_tracking", f"""WITH {ALIGNED}, src AS (SELECT pair_id, "left" AS c0, "right" AS r0 FROM al), {axis_sql('src', 'pair_id')} SELECT * FROM ax""")
def q_axis(spark, d):
    return rounded(P.axis_tracking(A.align_pairs(pair_samples(spark, d), KEY).rows, KEY))


# Six roles on one 10 ms grid, actuators four milliseconds late.
ROLES = ["jx", "jy", "yaw", "left", "right", "front"]


def role_signals(spark, d, names=None):
    role = F.get(F.lit(names or ROLES), (F.col("event_id") % 6).cast("int"))
    late = F.when(F.col("event_id") % 6 >= 3, 4_000_000).otherwise(0)
    return table(spark, d, "events").select(F.lit("all").alias("set_id"), role.alias("role"), F.col("event_id").alias("frame_index"),
                                            (F.floor(F.col("event_id") / 6) * 10_000_000 + late).alias("ts_ns"), "value")


def role_pair_sql(name: str, left: str, right: str) -> str:
    """Aligned rows of two role expressions; sides may sit on different grids."""
    def side(tag, src):
        return f"{name}{tag} AS (SELECT ts_ns, ts_ns / 1e9 AS t, v, lead(ts_ns / 1e9) OVER (ORDER BY ts_ns) AS t1, lead(v) OVER (ORDER BY ts_ns) AS v1 FROM ({src}))"

    def val(tag):
        return f"CASE WHEN {name}{tag}.ts_ns = m.ts_ns OR {name}{tag}.t1 IS NULL THEN {name}{tag}.v ELSE {name}{tag}.v + ({name}{tag}.v1 - {name}{tag}.v) * ((m.t - {name}{tag}.t) / ({name}{tag}.t1 - {name}{tag}.t)) END"

    return f"""{side('l', left)}, {side('r', right)},
{name} AS (SELECT m.ts_ns, m.t, {val('l')} AS c0, {val('r')} AS r0 FROM (SELECT DISTINCT ts_ns, ts_ns / 1e9 AS t FROM (SELECT ts_ns FROM {name}l UNION ALL SELECT ts_ns FROM {name}r)
  WHERE ts_ns BETWEEN greatest((SELECT min(ts_ns) FROM {name}l), (SELECT min(ts_ns) FROM {name}r)) AND least((SELECT max(ts_ns) FROM {name}l), (SELECT max(ts_ns) FROM {name}r))) m
  ASOF JOIN {name}l ON m.ts_ns >= {name}l.ts_ns ASOF JOIN {name}r ON m.ts_ns >= {name}r.ts_ns)"""


ROLE = "ro AS (SELECT event_id % 6 AS role, (event_id // 6) * 10000000 + CASE WHEN event_id % 6 >= 3 THEN 4000000 ELSE 0 END AS ts_ns, value AS v FROM events)"


def role(n):
    return f"SELECT ts_ns, v FROM ro WHERE role = {n}"


TRACK = f"""{ROLE}, {role_pair_sql('px', role(0), role(3))}, {role_pair_sql('py', role(1), role(4))}"""


@query("track_actuators", f"""WITH {TRACK}, src AS (SELECT 'X' AS axis, c0, r0 FROM px UNION ALL SELECT 'Y', c0, r0 FROM py), {axis_sql('src', 'axis')} SELECT 'all' AS set_id, * FROM ax""")
def q_track(spark, d):
    names = ["jx", "jy", "yaw", "ax", "ay", "front"]
    return rounded(P.track_actuators(role_signals(spark, d, names), ["set_id"]).axes)


PATHS = f"""{ROLE}, {role_pair_sql('pj', role(0), role(1))}, {role_pair_sql('pa', role(3), role(4))},
cs AS (SELECT quantile_cont(c0, 0.5) AS cx, quantile_cont(r0, 0.5) AS cy, greatest(quantile_cont(c0, 0.99) - quantile_cont(c0, 0.01), quantile_cont(r0, 0.99) - quantile_cont(r0, 0.01)) / 2 AS s FROM pj),
jp AS (SELECT t, (c0 - cx) / s AS x, (r0 - cy) / s AS y FROM pj, cs), ap AS (SELECT t, (c0 - cx) / s AS x, (r0 - cy) / s AS y FROM pa, cs),
b4 AS (SELECT jp.t, jp.x, jp.y, ap.t AS bt, ap.x AS bx, ap.y AS by0 FROM jp ASOF LEFT JOIN ap ON jp.t >= ap.t),
nx AS (SELECT b4.*, ap.t AS nt, ap.x AS nx, ap.y AS ny FROM b4 ASOF LEFT JOIN ap ON b4.t < ap.t),
er AS (SELECT 'all' AS set_id, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN sqrt((x - bx) * (x - bx) + (y - by0) * (y - by0)) ELSE sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) END AS error FROM nx)"""


def tracking(spark, d):
    return P.track_actuators(role_signals(spark, d, ["jx", "jy", "yaw", "ax", "ay", "front"]), ["set_id"])


@query("vector_error", f"WITH {PATHS} SELECT set_id, count(*) AS n, round(avg(error), 6) AS mean_error, round(max(error), 6) AS max_error, round(quantile_cont(error, 0.95), 6) AS p95_error FROM er GROUP BY 1")
def q_vector(spark, d):
    return rounded(tracking(spark, d).vector)


@query("vector_histogram", f"WITH {PATHS}, {histogram_sql('er', 'set_id', 'error', 40, low='0', high='greatest(1.0, quantile_cont(v, 0.99))')} SELECT * FROM hg")
def q_vector_histogram(spark, d):
    return rounded(tracking(spark, d).vector_histogram)


def probes(spark, d):
    """Every event of any type asks about the series of the errors."""
    rows = events(spark, d)
    return rows.select(F.lit("error").alias("message_name"), (F.col("ts_ns") / F.lit(1e9) + 0.25).alias("t"), F.col("event_id").alias("probe"))


PROBES = SAMPLES + """, pr AS (SELECT event_id AS probe, ts_ns / 1e9 + 0.25 AS pt FROM ev), er AS (SELECT * FROM sl WHERE message_name = 'error'),
pb AS (SELECT probe, pt, t AS bt, value AS bv FROM pr ASOF LEFT JOIN er ON pt >= t), pn AS (SELECT pb.*, t AS nt, value AS nv FROM pb ASOF LEFT JOIN er ON pt < t)"""


@query("nearest_sample", f"WITH {PROBES} SELECT probe, round(CASE WHEN bt IS NOT NULL AND (nt IS NULL OR pt - bt <= nt - pt) THEN bt ELSE nt END, 6) AS near_t, CASE WHEN bt IS NOT NULL AND (nt IS NULL OR pt - bt <= nt - pt) THEN bv ELSE nv END AS near_value FROM pn")
def q_nearest(spark, d):
    rows = samples(spark, d).where("message_name = 'error'").drop("signal_name")
    return rounded(A.nearest_sample(rows, probes(spark, d), ["message_name"]).select("probe", "near_t", "near_value"))


@query("snap_time", f"""WITH {SAMPLES}, pr AS (SELECT DISTINCT CAST((event_id // 10) * 500 AS DOUBLE) AS pt FROM events),
x AS (SELECT pt, m.message_name FROM pr, (SELECT DISTINCT message_name FROM sa) m),
pb AS (SELECT x.*, t AS bt, value AS bv FROM x ASOF LEFT JOIN sa ON x.message_name = sa.message_name AND pt >= t),
pn AS (SELECT pb.*, t AS nt, value AS nv FROM pb ASOF LEFT JOIN sa ON pb.message_name = sa.message_name AND pt < t),
c AS (SELECT pt, message_name, CASE WHEN bt IS NOT NULL AND (nt IS NULL OR pt - bt <= nt - pt) THEN bt ELSE nt END AS near_t,
  CASE WHEN bt IS NOT NULL AND (nt IS NULL OR pt - bt <= nt - pt) THEN bv ELSE nv END AS near_value FROM pn)
SELECT pt AS probe_t, round(abs(near_t - pt), 6) AS distance, message_name, round(near_t, 6) AS near_t, near_value FROM c QUALIFY row_number() OVER (PARTITION BY pt ORDER BY abs(near_t - pt), message_name) = 1""")
def q_snap(spark, d):
    rows = samples(spark, d).drop("signal_name")
    at = table(spark, d, "events").select((F.floor(F.col("event_id") / 10) * 500.0).alias("t")).distinct()
    names = ["click", "error", "purchase", "signup", "view"]
    asked = at.withColumn("message_name", F.explode(F.lit(names))).withColumn("probe_t", F.col("t"))
    return rounded(A.snap_time(rows, asked, ["message_name"], ["probe_t"]))


@query("next_change", f"WITH {PROBES}, ch AS (SELECT * FROM er WHERE abs(value - v0) > 1e-9) SELECT probe, round(t, 6) AS next_change_s FROM pr ASOF LEFT JOIN ch ON pt < t")
def q_next_change(spark, d):
    rows = samples(spark, d).where("message_name = 'error'").drop("signal_name")
    return rounded(A.next_change(rows, probes(spark, d), ["message_name"], ["probe"]))


# --- delay ---
GRID = STEPS + """, dt AS (SELECT pair_id, side, ts_ns / 1e9 AS t, value, ts_ns / 1e9 - lag(ts_ns / 1e9) OVER (PARTITION BY pair_id, side ORDER BY ts_ns) AS dt FROM ss),
md AS (SELECT pair_id, min(m) AS fine, max(lo) AS s, min(hi) AS e FROM (SELECT pair_id, side, quantile_cont(dt, 0.5) AS m, min(t) AS lo, max(t) AS hi FROM dt GROUP BY ALL) GROUP BY 1),
gn AS (SELECT pair_id, s, e, greatest(3, CAST(ceil((e - s) / fine) AS BIGINT) + 1) AS points FROM md),
gr AS (SELECT pair_id, points, i, s + i * ((e - s) / (points - 1)) AS t, (e - s) / (points - 1) AS step FROM (SELECT *, unnest(range(points)) AS i FROM gn)),
sl AS (SELECT pair_id, t, value AS v, lead(t) OVER w AS t1, lead(value) OVER w AS v1 FROM dt WHERE side = 'L' WINDOW w AS (PARTITION BY pair_id ORDER BY t)),
sr AS (SELECT pair_id, t, value AS v, lead(t) OVER w AS t1, lead(value) OVER w AS v1 FROM dt WHERE side = 'R' WINDOW w AS (PARTITION BY pair_id ORDER BY t)),
gv AS (SELECT gr.pair_id, points, i, gr.t, step, CASE WHEN sl.t1 IS NULL THEN sl.v ELSE sl.v + (sl.v1 - sl.v) * ((gr.t - sl.t) / (sl.t1 - sl.t)) END AS "left",
  CASE WHEN sr.t1 IS NULL THEN sr.v ELSE sr.v + (sr.v1 - sr.v) * ((gr.t - sr.t) / (sr.t1 - sr.t)) END AS "right"
  FROM gr ASOF JOIN sl ON gr.pair_id = sl.pair_id AND gr.t >= sl.t ASOF JOIN sr ON gr.pair_id = sr.pair_id AND gr.t >= sr.t)"""


@query("grid_resample", f'WITH {GRID} SELECT pair_id, i, round(t, 6) AS t, round("left", 5) AS "left", round("right", 5) AS "right" FROM gv')
def q_grid(spark, d):
    pairs = step_samples(spark, d)
    out = DL.grid_resample(pairs, KEY, DL.grid_bounds(pairs, KEY))
    return out.select("pair_id", "i", F.round("t", 6).alias("t"), F.round("left", 5).alias("left"), F.round("right", 5).alias("right"))


CURVE = STEPS + """, w AS (SELECT pair_id, rn AS i, max(value) FILTER (side = 'L') AS a, max(value) FILTER (side = 'R') AS b FROM (SELECT *, ts_ns // 10000000 AS rn FROM ss) GROUP BY ALL),
s AS (SELECT x.pair_id, k, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * b) AS sab, sum(a * a) AS saa, sum(b * b) AS sbb FROM (SELECT pair_id, i, a, unnest(range(-25, 26)) AS k FROM w) x
  JOIN (SELECT pair_id, i, b FROM w) y ON x.pair_id = y.pair_id AND y.i = x.i + x.k GROUP BY ALL),
lc AS (SELECT pair_id, CAST(k AS INT) AS k, n, CASE WHEN n <= 1 OR sqrt(greatest(0, (saa / n - sa / n * sa / n) * (sbb / n - sb / n * sb / n))) <= 1e-12 THEN 0
  ELSE (sab / n - sa / n * sb / n) / sqrt((saa / n - sa / n * sa / n) * (sbb / n - sb / n * sb / n)) END AS correlation FROM s)"""


@query("lag_curve", f"WITH {CURVE} SELECT pair_id, k, n, round(correlation, 6) AS correlation FROM lc")
def q_lag_curve(spark, d):
    rows = step_samples(spark, d).groupBy("pair_id", F.floor(F.col("ts_ns") / 10_000_000).alias("i")).agg(
        F.max(F.when(F.col("side") == "L", F.col("value"))).alias("a"), F.max(F.when(F.col("side") == "R", F.col("value"))).alias("b"))
    reach = rows.groupBy("pair_id").agg(F.lit(25).cast("long").alias("reach"))
    return rounded(DL.lag_curve(rows, KEY, reach))


EDGES = STEPS + """, lg AS (SELECT *, ts_ns / 1e9 AS t, value - lag(value) OVER w AS dv, ts_ns / 1e9 - lag(ts_ns / 1e9) OVER w AS dt FROM ss WINDOW w AS (PARTITION BY pair_id, side ORDER BY ts_ns)),
pv AS (SELECT *, abs(coalesce(lag(dv) OVER (PARTITION BY pair_id, side ORDER BY ts_ns), 0)) AS quiet FROM lg),
th AS (SELECT pair_id, side, greatest(1e-9, quantile_cont(value, 0.99) - quantile_cont(value, 0.01)) AS range, quantile_cont(abs(dv), 0.8) AS p80, quantile_cont(CASE WHEN dt > 0 THEN dt END, 0.5) AS mid FROM pv GROUP BY ALL)"""


@query("edge_events", f"""WITH {EDGES} SELECT pair_id, round(t, 6) AS t, CAST(sign(dv) AS INT) AS direction, round(abs(dv), 6) AS magnitude FROM pv JOIN th USING (pair_id, side)
  WHERE side = 'R' AND abs(dv) >= greatest(1e-5, 0.02 * range, 2.5 * p80) AND quiet < 0.45 * greatest(1e-5, 0.02 * range, 2.5 * p80)""")
def q_edges(spark, d):
    return rounded(E.edge_events(points(spark, d, "R"), KEY, window=1.5).select("pair_id", "t", "direction", "magnitude"))


def points(spark, d, side):
    return step_samples(spark, d).where(F.col("side") == side).select(
        "pair_id", (F.col("ts_ns") / F.lit(1e9)).alias("t"), F.col("frame_index").alias("pos"), F.col("value").alias("v"))


@query("change_events", f"""WITH {EDGES} SELECT pair_id, round(t, 6) AS t, CAST(sign(dv) AS INT) AS direction FROM pv JOIN th USING (pair_id, side)
  WHERE side = 'L' AND abs(dv) >= greatest(1e-5, 0.2 * range, 2.5 * p80) AND quiet < 0.45 * greatest(1e-5, 0.2 * range, 2.5 * p80)""")
def q_change_events(spark, d):
    return rounded(E.change_events(points(spark, d, "L"), KEY, fraction=0.2, gap_multiplier=5).select("pair_id", "t", "direction"))


@query("command_steps", f"WITH {EDGES} SELECT pair_id, round(t, 6) AS t, CAST(sign(dv) AS INT) AS direction FROM pv JOIN th USING (pair_id, side) WHERE side = 'L' AND abs(dv) >= 0.3 * range")
def q_command_steps(spark, d):
    return rounded(E.command_steps(points(spark, d, "L"), KEY, window=1.5).select("pair_id", "t", "direction"))


@query("every_nth_event", f"""WITH {EDGES}, e AS (SELECT pair_id, t, row_number() OVER (PARTITION BY pair_id ORDER BY t) - 1 AS no, count(*) OVER (PARTITION BY pair_id) AS n FROM pv WHERE side = 'L' AND abs(dv) >= 0.3)
SELECT pair_id, round(t, 6) AS t FROM e WHERE n <= 7 OR no % greatest(1, n // 7) = 0 OR no = n - 1""")
def q_every_nth(spark, d):
    steps = E.command_steps(points(spark, d, "L"), KEY, window=1.5)
    return rounded(E.every_nth_event(steps, KEY, 7).select("pair_id", "t"))


@query("thin_by_gap", f"""WITH RECURSIVE {SAMPLES}, c AS (SELECT message_name, frame_index, t FROM sa), nx AS MATERIALIZED (SELECT c.message_name, c.frame_index, n.frame_index AS next_index
  FROM c ASOF JOIN c n ON c.message_name = n.message_name AND c.t + 4000 <= n.t),
k AS (SELECT message_name, arg_min(frame_index, t) AS frame_index FROM c GROUP BY 1 UNION ALL SELECT k.message_name, next_index FROM k JOIN nx USING (message_name, frame_index))
SELECT * FROM k""")
def q_thin(spark, d):
    rows = samples(spark, d).select("message_name", (F.col("ts_ns") / F.lit(1e9)).alias("t"), F.col("frame_index").alias("pos"), F.lit(4000.0).alias("gap"))
    return E.thin_by_gap(rows, ["message_name"]).select("message_name", F.col("pos").alias("frame_index"))


def command_rows(spark, d):
    rows = events(spark, d).select((F.col("user_id") % 5).alias("grp"), (F.col("ts_ns") / F.lit(1e9)).alias("t"), F.col("event_id").alias("pos"),
                                   F.when(F.col("value") >= 20, 1).otherwise(-1).alias("direction"), F.col("event_type").isin("click", "purchase").alias("is_command"))
    return rows.where("is_command"), rows.where("not is_command")


@query("match_edges", """WITH RECURSIVE r AS (SELECT user_id % 5 AS grp, (epoch_us(ts) - 1704067200000000) * 1000 / 1e9 AS t, CASE WHEN value >= 20 THEN 1 ELSE -1 END AS dir,
  event_type IN ('click', 'purchase') AS cmd FROM events),
c AS (SELECT grp, t, dir, row_number() OVER (PARTITION BY grp ORDER BY t) AS no FROM r WHERE cmd), p AS (SELECT grp, t, dir FROM r WHERE NOT cmd),
m AS (SELECT grp, CAST(0 AS BIGINT) AS no, CAST(NULL AS DOUBLE) AS command_t, CAST(NULL AS DOUBLE) AS response_t, CAST(0 AS INT) AS direction, CAST(-1 AS DOUBLE) AS spent FROM c GROUP BY grp
  UNION ALL SELECT grp, no, ct, hit, dir, coalesce(hit, spent) FROM (SELECT m.grp, c.no, c.t AS ct, c.dir, m.spent,
    (SELECT min(p.t) FROM p WHERE p.grp = c.grp AND p.dir = c.dir AND p.t > greatest(c.t, m.spent) AND p.t - c.t <= 7200) AS hit FROM m JOIN c ON c.grp = m.grp AND c.no = m.no + 1))
SELECT grp, command_t, response_t, response_t - command_t AS delay_s, direction FROM m WHERE response_t IS NOT NULL""")
def q_match_edges(spark, d):
    commands, responses = command_rows(spark, d)
    return E.match_edges(commands, responses, ["grp"], window=7200.0)


DEAD = EDGES + """, st AS (SELECT pair_id, t AS et, sign(dv) AS dir FROM pv JOIN th USING (pair_id, side) WHERE side = 'L' AND abs(dv) >= 0.3 * range),
rs AS (SELECT pair_id, t, value, lag(t) OVER (PARTITION BY pair_id ORDER BY t) AS t0, lag(value) OVER (PARTITION BY pair_id ORDER BY t) AS v0 FROM pv WHERE side = 'R'),
lv AS (SELECT pair_id, greatest(1e-9, range * 0.02) AS level FROM th WHERE side = 'R'),
bs AS (SELECT st.*, rs.value AS base, rs.value + dir * level AS target FROM st JOIN lv USING (pair_id) JOIN rs ON rs.pair_id = st.pair_id AND rs.t = et),
ht AS (SELECT bs.*, rs.t, rs.value, rs.t0, rs.v0, row_number() OVER (PARTITION BY bs.pair_id, et ORDER BY rs.t) AS rk FROM bs LEFT JOIN rs ON rs.pair_id = bs.pair_id AND rs.t > et AND rs.t - et <= 1.5
  AND CASE WHEN dir > 0 THEN rs.value >= target ELSE rs.value <= target END),
dd AS (SELECT pair_id, et AS command_t, CAST(dir AS INT) AS direction, greatest(et, t0) + (t - greatest(et, t0)) * least(1, greatest(0, (target - CASE WHEN t0 > et THEN v0 ELSE base END) / (value - CASE WHEN t0 > et THEN v0 ELSE base END))) - et AS dead
  FROM ht WHERE rk = 1)"""


@query("first_response", f"WITH {DEAD} SELECT pair_id, round(command_t, 6) AS command_t, direction, round(dead, 6) AS dead_time_s FROM dd")
def q_first_response(spark, d):
    return rounded(DL.first_response(step_samples(spark, d), KEY))


@query("first_response_delay", f"""WITH {DEAD} SELECT pair_id, count(*) AS command_edges, count(dead) AS matched_edges, count(dead) AS all_n, round(avg(dead), 6) AS all_mean_s, round(min(dead), 6) AS all_min_s,
  round(max(dead), 6) AS all_max_s, round(quantile_cont(dead, 0.95), 6) AS all_p95_s, count(dead) FILTER (direction > 0) AS rising_n, round(avg(dead) FILTER (direction > 0), 6) AS rising_mean_s,
  round(min(dead) FILTER (direction > 0), 6) AS rising_min_s, round(max(dead) FILTER (direction > 0), 6) AS rising_max_s, round(quantile_cont(dead, 0.95) FILTER (direction > 0), 6) AS rising_p95_s,
  count(dead) FILTER (direction < 0) AS falling_n, round(avg(dead) FILTER (direction < 0), 6) AS falling_mean_s, round(min(dead) FILTER (direction < 0), 6) AS falling_min_s,
  round(max(dead) FILTER (direction < 0), 6) AS falling_max_s, round(quantile_cont(dead, 0.95) FILTER (direction < 0), 6) AS falling_p95_s FROM dd GROUP BY pair_id""")
def q_dead_time(spark, d):
    return rounded(DL.first_response_delay(step_samples(spark, d), KEY).summary)


@query("dead_time_histogram", f"WITH {DEAD}, {histogram_sql('dd', 'pair_id', 'dead', 30, low='0', high='greatest(0.02, quantile_cont(v, 0.99))')} SELECT pair_id, bin, count FROM hg")
def q_dead_histogram(spark, d):
    return DL.first_response_delay(step_samples(spark, d), KEY).histogram.select("pair_id", "bin", "count")


@query("delay_event_stats", f"""WITH {DEAD}, g AS (SELECT pair_id, 'all' AS edges, dead FROM dd UNION ALL SELECT pair_id, CASE WHEN direction > 0 THEN 'rising' ELSE 'falling' END, dead FROM dd)
SELECT pair_id, edges, count(*) AS n, round(avg(dead), 6) AS mean_s, round(min(dead), 6) AS min_s, round(max(dead), 6) AS max_s, round(quantile_cont(dead, 0.95), 6) AS p95_s FROM g WHERE dead IS NOT NULL GROUP BY ALL""")
def q_delay_stats(spark, d):
    rows = DL.first_response(step_samples(spark, d), KEY).where("dead_time_s is not null")
    return rounded(E.delay_event_stats(rows, KEY, "dead_time_s"))


@query("combined_delay", f"""WITH {DEAD} SELECT 'all' AS edges, count(dead) AS n, round(avg(dead), 6) AS mean_s, round(min(dead), 6) AS min_s, round(max(dead), 6) AS max_s FROM dd""")
def q_combined(spark, d):
    rows = DL.first_response(step_samples(spark, d), KEY).where("dead_time_s is not null")
    return rounded(E.combined_delay(E.delay_event_stats(rows, KEY, "dead_time_s").where("edges = 'all'"), ["edges"]))


@query("delay_by_threshold", f"""WITH {SAMPLES},
x AS (SELECT message_name, pos AS i, t, value AS c, (value + coalesce(v0, value)) / 2 AS r FROM sl),
y AS (SELECT *, lag(t) OVER w AS t0, lag(c) OVER w AS c0, lag(r) OVER w AS r0, min(c) OVER p + (max(c) OVER p - min(c) OVER p) * 0.2 AS cl, min(r) OVER p + (max(r) OVER p - min(r) OVER p) * 0.2 AS rl
  FROM x WINDOW w AS (PARTITION BY message_name ORDER BY i), p AS (PARTITION BY message_name)),
cc AS (SELECT message_name, arg_min(t0 + (t - t0) * ((cl - c0) / (c - c0)), i) AS tc FROM y WHERE c0 < cl AND c >= cl GROUP BY 1),
rr AS (SELECT message_name, arg_min(t0 + (t - t0) * ((rl - r0) / (r - r0)), i) AS tr FROM y WHERE r0 < rl AND r >= rl GROUP BY 1)
SELECT message_name, round(tr - tc, 4) AS threshold_delay_s FROM cc JOIN rr USING (message_name)""")
def q_threshold(spark, d):
    """The response is the mean of a value and the one before it."""
    o = ordered(samples(spark, d), ["message_name"], ["ts_ns", "frame_index"]).lag(prev="value").number("i")
    rows = o.done().select("message_name", "i", (F.col("ts_ns") / F.lit(1e9)).alias("t"), F.col("value").alias("c"),
                           ((F.col("value") + F.coalesce("prev", "value")) / 2).alias("r"))
    return rounded(DL.delay_by_threshold(rows, ["message_name"], 0.2), 4)


DELAY = GRID + """, qn AS (SELECT pair_id, (quantile_cont("left", 0.01) + quantile_cont("left", 0.99)) * 0.5 AS cc, greatest(1e-9, (quantile_cont("left", 0.99) - quantile_cont("left", 0.01)) * 0.5) AS cs,
  (quantile_cont("right", 0.01) + quantile_cont("right", 0.99)) * 0.5 AS rc, greatest(1e-9, (quantile_cont("right", 0.99) - quantile_cont("right", 0.01)) * 0.5) AS rs FROM gv GROUP BY 1),
nv AS (SELECT gv.*, rc, rs, greatest(-3, least(3, ("left" - cc) / cs)) AS c, greatest(-3, least(3, ("right" - rc) / rs)) AS r FROM gv JOIN qn USING (pair_id)),
d1 AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (c - lag(c) OVER w) / step END AS dc, CASE WHEN i = 0 THEN 0 ELSE (r - lag(r) OVER w) / step END AS dr FROM nv WINDOW w AS (PARTITION BY pair_id ORDER BY i)),
d2 AS (SELECT pair_id, i, points, step, CASE WHEN i = 0 OR i = points - 1 THEN dc ELSE (lag(dc) OVER w + dc + lead(dc) OVER w) / 3 END AS a,
  CASE WHEN i = 0 OR i = points - 1 THEN dr ELSE (lag(dr) OVER w + dr + lead(dr) OVER w) / 3 END AS b FROM d1 WINDOW w AS (PARTITION BY pair_id ORDER BY i)),
kk AS (SELECT pair_id, i, a, unnest(range(-CAST(round(0.3 / step) AS BIGINT), CAST(round(0.3 / step) AS BIGINT) + 1)) AS k, step FROM d2),
su AS (SELECT kk.pair_id, k, any_value(step) AS step, count(*) AS n, sum(a) AS sa, sum(b) AS sb, sum(a * b) AS sab, sum(a * a) AS saa, sum(b * b) AS sbb
  FROM kk JOIN (SELECT pair_id, i, b FROM d2) y ON y.pair_id = kk.pair_id AND y.i = kk.i + kk.k GROUP BY ALL),
cu AS (SELECT pair_id, k, k * step AS lag_s, n, (sab / n - sa / n * sb / n) / sqrt((saa / n - sa / n * sa / n) * (sbb / n - sb / n * sb / n)) AS correlation FROM su),
be AS (SELECT pair_id, lag_s, correlation FROM cu QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round(abs(correlation), 12) DESC, k) = 1)"""


@query("delay_curve", f"WITH {DELAY} SELECT pair_id, CAST(k AS INT) AS k, n, round(lag_s, 6) AS lag_s, round(correlation, 6) AS correlation FROM cu")
def q_delay_curve(spark, d):
    return rounded(DL.analyze_delay(step_samples(spark, d), KEY, search_range_s=0.3).curve.select("pair_id", "k", "n", "lag_s", "correlation"))


@query("analyze_delay", f"""WITH {DELAY}, sh AS (SELECT nv.pair_id, nv.i, nv.c, rc, rs, nv.t + lag_s AS x FROM nv JOIN be USING (pair_id)),
sv AS (SELECT sh.pair_id, abs(greatest(-3, least(3, ((CASE WHEN sr.t1 IS NULL THEN sr.v ELSE sr.v + (sr.v1 - sr.v) * ((x - sr.t) / (sr.t1 - sr.t)) END) - rc) / rs)) - c) AS error
  FROM sh JOIN md USING (pair_id) ASOF JOIN sr ON sh.pair_id = sr.pair_id AND x >= sr.t WHERE x <= (SELECT max(t) FROM sr z WHERE z.pair_id = sh.pair_id))
SELECT pair_id, 'Valid' AS status, count(*) AS n, round(any_value(lag_s), 6) AS lag_s, round(any_value(correlation), 6) AS correlation, round(avg(error), 4) AS mean_abs_error, round(max(error), 4) AS max_abs_error
FROM sv JOIN be USING (pair_id) GROUP BY pair_id""")
def q_analyze_delay(spark, d):
    s = DL.analyze_delay(step_samples(spark, d), KEY, search_range_s=0.3).summary
    return rounded(s.select("pair_id", "status", "n", "lag_s", "correlation", F.round("mean_abs_error", 4).alias("mean_abs_error"),
                            F.round("max_abs_error", 4).alias("max_abs_error")))


@query("delay_summary", None)
def q_delay_summary(spark, d):
    return rounded(DL.analyze_delay(step_samples(spark, d), KEY).summary)


@query("delay_matches", f"""WITH {EDGES}, e AS (SELECT pair_id, side, t, sign(dv) AS dir FROM pv WHERE abs(dv) > 0.1),
m AS (SELECT l.pair_id, l.t, l.dir, min(r.t) AS rt FROM e l JOIN e r ON l.pair_id = r.pair_id AND l.side = 'L' AND r.side = 'R' AND l.dir = r.dir AND r.t > l.t AND r.t - l.t <= 0.4 GROUP BY ALL)
SELECT pair_id, round(t, 6) AS command_t, round(rt - t, 6) AS delay_s, CAST(dir AS INT) AS direction FROM m""")
def q_delay_matches(spark, d):
    """Steps are half a second apart, so within 0.4 s nothing competes."""
    commands = E.edge_events(points(spark, d, "L"), KEY, window=0.4)
    responses = E.edge_events(points(spark, d, "R"), KEY, window=0.4)
    return rounded(E.match_edges(commands, responses, KEY, window=0.4).select("pair_id", "command_t", "delay_s", "direction"))


FLY = f"""{ROLE}, {role_pair_sql('st', role(1), role(2))},
{role_pair_sql('pl', 'SELECT ts_ns, -c0 - r0 AS v FROM st', role(3))}, {role_pair_sql('pr', 'SELECT ts_ns, -c0 + r0 AS v FROM st', role(4))}, {role_pair_sql('pf', role(0), role(5))},
src AS (SELECT 'Left' AS actuator, c0, r0 FROM pl UNION ALL SELECT 'Right', c0, r0 FROM pr UNION ALL SELECT 'Front', c0, r0 FROM pf)"""


@query("butterfly", f"WITH {FLY}, {axis_sql('src', 'actuator')} SELECT 'all' AS set_id, * FROM ax")
def q_butterfly(spark, d):
    return rounded(DL.butterfly(role_signals(spark, d), ["set_id"]).axes)


@query("butterfly_delays", None)
def q_butterfly_delays(spark, d):
    return rounded(DL.butterfly(role_signals(spark, d), ["set_id"]).delays)


# --- signals by name ---
@query("suggest_signals", """WITH l AS (SELECT DISTINCT 'Joy' || CAST(p_size AS VARCHAR) || CASE p_size % 4 WHEN 0 THEN '.pos_x' WHEN 1 THEN '.pos_y' WHEN 2 THEN '.yaw' ELSE '.actualpos_left' END AS label FROM part),
b AS (SELECT 'jx' AS role, min(label) AS label FROM l WHERE contains(label, '.pos_x') UNION ALL SELECT 'jy', min(label) FROM l WHERE contains(label, '.pos_y')
  UNION ALL SELECT 'yaw', min(label) FROM l WHERE contains(label, '.yaw') UNION ALL SELECT 'left', min(label) FROM l WHERE contains(label, '_left'))
SELECT * FROM b""")
def q_suggest(spark, d):
    size = F.col("p_size")
    tail = F.when(size % 4 == 0, ".pos_x").when(size % 4 == 1, ".pos_y").when(size % 4 == 2, ".yaw").otherwise(".actualpos_left")
    labels = table(spark, d, "part").select(F.concat(F.lit("Joy"), size.cast("string"), tail).alias("label"))
    return suggest_signals(labels).where(F.col("role").isin("jx", "jy", "yaw", "left"))


@query("resolve_refs", """WITH c AS (SELECT DISTINCT event_type, user_id % 3 AS ch FROM events), n AS (SELECT event_type, count(*) AS m FROM c GROUP BY 1)
SELECT DISTINCT CAST(e.user_id AS INT) AS ord, CAST(CASE WHEN user_id % 7 = 0 THEN 0 WHEN user_id % 2 = 0 THEN 1 ELSE m END AS BIGINT) AS matches, CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 2 = 0 OR m = 1
  THEN 'click.value [can' || CAST(user_id % 3 AS VARCHAR) || ' | CAN | Std | 0x1]' END AS label, CAST(user_id AS DOUBLE) AS "offset" FROM events e, (SELECT m FROM n WHERE event_type = 'click')""")
def q_resolve(spark, d):
    """Saved selections derived from the users: even ids name a full identity, odd ones only the text, every seventh a missing signal."""
    u = F.col("user_id")
    ev = table(spark, d, "events")
    cat = ev.select(F.col("event_type").alias("message_name"), F.lit("value").alias("signal_name"), F.concat(F.lit("can"), (u % 3).cast("string")).alias("channel"),
                    F.lit("Classic").alias("frame_format"), F.lit(False).alias("is_extended"), F.lit(1).cast("long").alias("frame_id")).distinct()
    name = F.when(u % 7 == 0, "gone").otherwise("click")
    users = ev.select("user_id").distinct()
    identity = F.struct(F.concat(F.lit("can"), (u % 3).cast("string")).alias("channel"), F.lit("0").alias("frame_format"), F.lit(False).alias("extended"),
                        F.lit(1).cast("long").alias("frame_id"), name.alias("message"), F.lit("value").alias("signal"), F.lit("").alias("display_label"))
    text = F.concat(name, F.lit(".value [x]"))
    none = F.array().cast("array<" + users.select(identity.alias("i")).schema["i"].dataType.simpleString() + ">")
    presets = users.select("user_id", F.lit("can-log-viewer-layout").alias("preset_type"), F.when(u % 2 == 0, 2).otherwise(1).alias("version"), u.cast("string").alias("preset_file"),
                           F.array(F.struct(F.lit("g").alias("title"), F.array(text).alias("signals"), F.when(u % 2 == 0, F.array(identity)).otherwise(none).alias("signal_identities"),
                                            F.create_map(text, u.cast("double")).alias("offsets"))).alias("plot_groups"))
    out = resolve_refs(signal_refs(presets), cat, strict=False)
    return out.select(F.col("preset_file").cast("int").alias("ord"), "matches", "label", "offset")
