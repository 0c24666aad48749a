import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from buslens.operators import align as A
from buslens.operators import delay as DL
from buslens.operators import edges as E
from buslens.operators import pairs as P
from buslens.operators import reduce as RD
from buslens.operators import series as S
from buslens.operators.ordered import ordered
from buslens.operators.quantiles import quantiles
from buslens.operators.traffic import bus_overview, bus_trend, cycle_timing

K = ["s"]
# Plain plans, and blocked plans forced by a tiny group limit.
LIMITS = [2_000_000, 7]
LONG_LIMITS = [2_000_000, 60]


def series(spark, data):
    """data: {name: [(seconds, value), ...]}"""
    rows = [(k, int(round(t * 1e9)), i, float(v)) for k, xs in data.items() for i, (t, v) in enumerate(xs)]
    return spark.createDataFrame(rows, "s string, ts_ns long, frame_index long, value double")


def wave(n=120, seed=3):
    rnd = random.Random(seed)
    return [(i * 0.01 + rnd.random() * 0.004, round(math.sin(i / 9) * 10 + rnd.random(), 3)) for i in range(n)]


def by_key(df, *cols):
    return {r["s"]: tuple(r[c] for c in cols) for r in df.collect()}


@pytest.mark.parametrize("limit", LIMITS)
def test_ordered_steps(spark, limit):
    xs = [(i * 0.5, None if i % 4 else i) for i in range(40)]
    rows = [("a", i, i // 4, v if v is None else float(v)) for i, (_, v) in enumerate(xs)] + [("b", 0, 1, None)]
    df = spark.createDataFrame(rows, "s string, pos long, x long, v double").repartition(5)
    o = ordered(df, K, ["pos"], max_group_rows=limit).lag(p="pos").lead(q="pos").number("no", "len").running_sum(total="x")
    got = sorted(tuple(r) for r in o.last_known(back="v").next_known(ahead="v").done().select("s", "pos", "p", "q", "no", "len", "total", "back", "ahead").collect())
    assert o.blocked == (limit == 7)
    want, total = [], 0
    for i in range(40):
        total += i // 4
        want.append(("a", i, i - 1 if i else None, i + 1 if i < 39 else None, i, 40, total, float(i // 4 * 4), float(-(-i // 4) * 4) if i <= 36 else None))
    assert got == [*want, ("b", 0, None, None, 0, 1, 1, None, None)]


@pytest.mark.parametrize("limit", LIMITS)
def test_quantiles(spark, limit):
    rnd = random.Random(1)
    data = {"a": [rnd.gauss(0, 3) for _ in range(101)], "b": [rnd.randint(0, 5) for _ in range(64)], "c": [4.5]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "s string, v double")
    qs = [0.0, 0.01, 0.5, 0.8, 0.95, 0.99, 1.0]
    got = by_key(quantiles(df, K, {f"q{i}": ("v", q) for i, q in enumerate(qs)}, max_group_rows=limit), *[f"q{i}" for i in range(len(qs))])
    for k, vs in data.items():
        assert got[k] == pytest.approx(tuple(np.quantile(vs, qs)), abs=1e-12)


@pytest.mark.parametrize("limit", LIMITS)
def test_signal_and_event_stats(spark, limit):
    data = {"x": [(0, -10), (1, -1), (2, 0), (3, 1), (4, 10), (5, 10)], "dup": [(0, 1), (0, 3), (1, 5)], "one": [(2, 7)],
            "steps": [(0, -1), (1, 1), (2, 1), (3, -1), (4, -1)], "w": wave()}
    df = series(spark, data)
    st = by_key(S.signal_stats(df, K, max_group_rows=limit), "n", "median", "std", "first_value", "last_value", "net_change", "duration_s")
    v = np.array([x[1] for x in data["x"]], float)
    assert st["x"] == pytest.approx((6, 0.5, v.std(), -10, 10, 20, 5))
    assert st["one"] == (1, 7, 0, 7, 7, 0, 0)
    ev = by_key(S.event_stats(df, K, max_group_rows=limit), "rising", "falling", "changes", "above_pct", "longest_above_s", "mean_abs_delta", "p95_abs_delta", "max_abs_slope", "flat_pct")
    assert ev["steps"] == pytest.approx((1, 1, 2, 50.0, 2.0, 1.0, 2.0, 2.0, 50.0))
    assert ev["dup"] == pytest.approx((0, 0, 2, 100.0, 1.0, 2.0, 2.0, 2.0, 0.0))
    assert ev["one"] == (0,) * 9
    t, y = np.array(data["w"]).T
    dt, d, up = np.diff(t), np.abs(np.diff(y)), y >= 0
    run = best = 0.0
    for i in range(len(dt)):
        run = run + dt[i] if up[i] else 0.0
        best = max(best, run)
    want = (np.sum(~up[:-1] & up[1:]), np.sum(up[:-1] & ~up[1:]), np.sum((d > 0) & (d >= 0.01)), 100 * dt[up[:-1]].sum() / dt.sum(), best, d.mean(),
            np.quantile(d, 0.95), (d / dt).max(), 100 * np.mean(d <= 1e-12))
    assert ev["w"] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("limit", LIMITS)
def test_histograms(spark, limit):
    df = series(spark, {"x": [(i, v) for i, v in enumerate([-10, -1, 0, 1, 10, 10])], "flat": [(0, 3), (1, 3)]})
    h = S.histogram(df, K, bins=10).collect()
    counts = {k: [r["count"] for r in sorted(h, key=lambda r: r["bin"]) if r["s"] == k] for k in ("x", "flat")}
    assert sum(counts["x"]) == 6 and counts["x"][-1] == 2 and len(counts["x"]) == 10 and counts["flat"] == [2] + [0] * 9
    assert sum(r["count"] for r in S.delta_histogram(df, K, bins=5, max_group_rows=limit).collect()) == 6
    c = [r["cumulative_pct"] for r in S.cdf(S.histogram(df, K, bins=10), K).orderBy("s", "bin").collect()]
    assert c[9] == 100 and c[19] == 100


@pytest.mark.parametrize("limit", LONG_LIMITS)
def test_downsampling(spark, limit):
    data = {"w": wave(503), "short": wave(9, 5)}
    df = series(spark, data)
    got = RD.downsample_minmax(df, K, 40, max_group_rows=limit).orderBy("s", "pos", "slot").collect()
    w = [r for r in got if r["s"] == "w"]
    assert len(w) == 40 and len([r for r in got if r["s"] == "short"]) == 9
    y = [v for _, v in data["w"]]
    want = []
    for i in range(20):
        a, b = math.floor(i * (503 / 20)), math.floor((i + 1) * (503 / 20))
        lo = min(range(a, b), key=lambda j: (y[j], j))
        hi = max(range(a, b), key=lambda j: (y[j], -j))
        want += sorted((lo, hi))
    assert [r["pos"] for r in w] == want
    kept = [r["pos"] for r in RD.stride_reduce(df, K, 100, max_group_rows=limit).orderBy("s", "pos").collect()]
    assert kept == [*range(9), *range(0, 503, 6), 502]


@pytest.mark.parametrize("limit", LIMITS)
def test_ranking_orders_by_activity(spark, limit):
    df = series(spark, {"calm": [(i, 1) for i in range(20)], "busy": [(i, (-1) ** i) for i in range(20)], "single": [(0, 1)]})
    got = S.rank_signals(df, K, change_threshold=0.0, top_n=5, max_group_rows=limit).collect()
    assert [r["s"] for r in got] == ["busy", "calm"]
    # A threshold of zero counts steps of zero as well.
    assert got[1]["changes"] == 19 and got[0]["score"] == pytest.approx(0.6 + 0.25 * 1 + 0.15 * 2)


def pair_rows(spark, pairs):
    rows = [(k, side, int(round(t * 1e9)), i, float(v)) for k, sides in pairs.items() for side, xs in zip("LR", sides) for i, (t, v) in enumerate(xs)]
    return spark.createDataFrame(rows, "s string, side string, ts_ns long, frame_index long, value double")


@pytest.mark.parametrize("limit", LIMITS)
def test_alignment(spark, limit):
    left, right = wave(80, 1), [(t + 0.003, v * 2) for t, v in wave(60, 2)]
    pairs = {"ok": (left, right), "gap": ([(0, 1), (1, 2), (2, 3), (100, 4)], [(0, 1), (1, 2), (2, 3), (100, 4)]), "apart": ([(0, 1), (1, 1)], [(5, 1), (6, 1)]),
             "empty": ([(0, 1), (1, 1)], []), "dup": ([(0, 1), (0, 3), (1, 5), (1, 9), (2, 5)], [(0, 0), (0.5, 0), (2, 0)])}
    out = A.align_pairs(pair_rows(spark, pairs), K, max_group_rows=limit)
    rep = {r["s"]: r for r in out.report.collect()}
    assert {k: r["status"] for k, r in rep.items()} == {"ok": "Valid", "gap": "GapExceeded", "apart": "InsufficientOverlap", "empty": "InsufficientOverlap", "dup": "Valid"}
    assert rep["gap"]["aligned_rows"] == 4 and rep["gap"]["coverage_pct"] == 100.0 and rep["empty"]["source_rows"] == 2 and rep["dup"]["duplicate_intervals"] == 2
    rows = [r for r in out.rows.orderBy("s", "ts_ns").collect()]
    assert {r["s"] for r in rows} == {"ok", "dup"}
    (tl, vl), (tr, vr) = np.array(left).T, np.array(right).T
    tl, tr = np.round(tl * 1e9) / 1e9, np.round(tr * 1e9) / 1e9
    times = sorted({t for t in [*tl, *tr] if max(tl[0], tr[0]) <= t <= min(tl[-1], tr[-1])})
    ok = [r for r in rows if r["s"] == "ok"]
    assert [r["t"] for r in ok] == times and rep["ok"]["aligned_rows"] == len(times)
    assert [r["left"] for r in ok] == pytest.approx(list(np.interp(times, tl, vl)), abs=1e-9)
    assert [r["right"] for r in ok] == pytest.approx(list(np.interp(times, tr, vr)), abs=1e-9)
    # First time gives the first duplicate, later times the last one; interpolation starts at the last one.
    assert [(r["t"], r["left"]) for r in rows if r["s"] == "dup"] == [(0, 1), (0.5, 4), (1, 9), (2, 5)]


@pytest.mark.parametrize("limit", LIMITS)
def test_nearest_and_next_change(spark, limit):
    df = series(spark, {"a": [(0, 1), (1, 1), (2, 5), (3, 5)], "b": [(0.5, 2), (4, 3)]})
    probes = spark.createDataFrame([(k, t, t) for k in ("a", "b", "none") for t in (-1.0, 0.5, 1.5, 2.0, 9.0)], "s string, t double, p double")
    near = {(r["s"], r["p"]): r["near_t"] for r in A.nearest_sample(df, probes, K, max_group_rows=limit).collect()}
    assert [near["a", p] for p in (-1.0, 0.5, 1.5, 2.0, 9.0)] == [0, 0, 1, 2, 3]
    assert [near["b", p] for p in (-1.0, 0.5, 1.5, 2.0, 9.0)] == [0.5, 0.5, 0.5, 0.5, 4] and near["none", 0.5] is None
    snap = {r["p"]: (r["s"], r["near_t"]) for r in A.snap_time(df, probes, K, ["p"], max_group_rows=limit).collect()}
    assert snap == {-1.0: ("a", 0), 0.5: ("b", 0.5), 1.5: ("a", 1), 2.0: ("a", 2), 9.0: ("b", 4)}
    nxt = {r["p"]: r["next_change_s"] for r in A.next_change(df, probes, K, ["p"], max_group_rows=limit).collect()}
    assert nxt == {-1.0: 2, 0.5: 2, 1.5: 2, 2.0: 4, 9.0: None}


@pytest.mark.parametrize("limit", LONG_LIMITS)
def test_pair_statistics(spark, limit):
    rnd = random.Random(4)
    t = np.cumsum([0.01 + rnd.random() * 0.01 for _ in range(150)])
    x, y = [rnd.uniform(-1, 1) for _ in t], [rnd.uniform(-1, 1) for _ in t]
    pairs = pair_rows(spark, {"p": (list(zip(t, x)), list(zip(t, y)))})
    out = P.analyze_pairs(pairs, K, max_group_rows=limit)
    s = out.stats.first()
    t = np.round(t * 1e9) / 1e9
    cx, cy = np.median(x), np.median(y)
    scale = max(np.quantile(x, .99) - np.quantile(x, .01), np.quantile(y, .99) - np.quantile(y, .01)) / 2
    nx, ny = (np.array(x) - cx) / scale, (np.array(y) - cy) / scale
    r, w = np.hypot(nx, ny), np.append(np.diff(t), 0)
    assert s["mean_radius"] == pytest.approx((r * w).sum() / w.sum()) and s["p95_radius"] == pytest.approx(np.quantile(r, .95))
    assert s["deadzone_pct"] == pytest.approx(100 * w[r <= .1].sum() / w.sum()) and s["saturation_pct"] == pytest.approx(100 * w[r >= .9].sum() / w.sum())
    assert s["path_length"] == pytest.approx(np.hypot(np.diff(nx), np.diff(ny)).sum())
    assert sum(s[f"quadrant{i}_pct"] for i in range(1, 5)) == pytest.approx(100)
    assert sum(h["count"] for h in out.radius_histogram.collect()) == 150
    a = P.axis_tracking(A.align_pairs(pairs, K).rows, K, max_group_rows=limit).first()
    half = (np.quantile(x, .99) - np.quantile(x, .01)) / 2
    c, q = (np.array(x) - cx) / half, (np.array(y) - cx) / half
    gain = np.cov(c, q, bias=True)[0, 1] / c.var()
    assert (a["correlation"], a["gain"], a["offset"], a["rmse"]) == pytest.approx((np.corrcoef(c, q)[0, 1], gain, q.mean() - gain * c.mean(), np.sqrt(((q - c) ** 2).mean())))


def test_pair_of_one_point_and_flat_axis(spark):
    out = P.analyze_pairs(pair_rows(spark, {"p": ([(1, 2)], [(1, 3)])}), K).stats.first()
    assert (out["n"], out["mean_radius"], out["deadzone_pct"], out["quadrant1_pct"]) == (1, 0, 100, 100)
    flat = P.axis_tracking(A.align_pairs(pair_rows(spark, {"p": ([(0, 2), (1, 2)], [(0, 3), (1, 4)])}), K).rows, K).first()
    assert flat["correlation"] == 0 and flat["gain"] == 0


def greedy(times, gap):
    kept, last = [], -math.inf
    for t in times:
        if t - last >= gap:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("limit", LONG_LIMITS)
def test_greedy_folds_against_plain_loops(spark, limit):
    rnd = random.Random(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        for gap in (0.5, 3.0):
            times = {k: sorted(rnd.sample(range(0, 400), 120)) for k in "ab"}
            cand = spark.createDataFrame([(k, t / 10, t, gap) for k, ts in times.items() for t in ts], "s string, t double, pos long, gap double")
            got = sorted((r["s"], r["t"]) for r in E.thin_by_gap(cand, K, slot_rows=limit).collect())
            assert got == [(k, t) for k in "ab" for t in greedy([t / 10 for t in times[k]], gap)]
        for same_time in (False, True):
            for window in (0.4, 2.5):
                data = {k: [[(t / 10, t, rnd.choice((1, -1))) for t in sorted(rnd.sample(range(0, 500), 90))] for _ in range(2)] for k in "ab"}
                frames = [spark.createDataFrame([(k, *x) for k in "ab" for x in data[k][n]], "s string, t double, pos long, direction int") for n in (0, 1)]
                got = sorted(tuple(r) for r in E.match_edges(*frames, K, window=window, same_time=same_time, slot_rows=limit)
                             .select("s", "command_t", "response_t", "direction").collect())
                want = []
                for k in "ab":
                    start, rs = 0, data[k][1]
                    for tc, _, dc in data[k][0]:
                        while start < len(rs) and (rs[start][0] < tc or (rs[start][0] == tc and not same_time)):
                            start += 1
                        hit = next((j for j in range(start, len(rs)) if rs[j][0] - tc <= window and rs[j][2] == dc), None)
                        if hit is not None:
                            want.append((k, tc, rs[hit][0], dc))
                            start = hit + 1
                assert got == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def lerp(t, v, x):
    return np.interp(x, t, v)


def numpy_delay(tc, vc, tr, vr, reach_s):
    """The delay analysis as a plain loop over arrays."""
    start, end = max(tc[0], tr[0]), min(tc[-1], tr[-1])
    fine = min(np.median(np.diff(tc)), np.median(np.diff(tr)))
    n = max(3, math.ceil((end - start) / fine) + 1)
    dt = (end - start) / (n - 1)
    t = start + np.arange(n) * dt

    def norm(raw):
        lo, hi = np.quantile(raw, [.01, .99])
        c, s = (lo + hi) / 2, max(1e-9, (hi - lo) / 2)
        return np.clip((raw - c) / s, -3, 3), c, s

    def slope(y):
        d = np.append(0, np.diff(y) / dt)
        out = d.copy()
        out[1:-1] = (d[:-2] + d[1:-1] + d[2:]) / 3
        return out

    c, _, _ = norm(lerp(tc, vc, t))
    r, rc, rs = norm(lerp(tr, vr, t))
    a, b = slope(c), slope(r)
    k_max = min(max(round(reach_s / dt), 1), n - 2)
    curve = {}
    for k in range(-k_max, k_max + 1):
        x, y = (a[:n - k], b[k:]) if k >= 0 else (a[-k:], b[:n + k])
        curve[k] = np.mean(x * y) - x.mean() * y.mean()
        curve[k] /= math.sqrt(max(0, (np.mean(x * x) - x.mean() ** 2) * (np.mean(y * y) - y.mean() ** 2)))
    best = max(curve, key=lambda k: (abs(curve[k]), -k))
    lag = best * dt
    inside = (t + lag >= tr[0]) & (t + lag <= tr[-1])
    err = np.abs(np.clip((lerp(tr, vr, (t + lag)[inside]) - rc) / rs, -3, 3) - c[inside])
    return lag, curve, err


@pytest.mark.parametrize("limit", LONG_LIMITS)
def test_delay_of_a_late_wave(spark, limit):
    tc = [i * 0.01 for i in range(300)]
    tr = [i * 0.02 for i in range(150)]
    command = [math.sin(2 * math.pi * t * 0.7) + 0.3 * math.sin(9 * t) for t in tc]
    response = [0.9 * (math.sin(2 * math.pi * (t - 0.04) * 0.7) + 0.3 * math.sin(9 * (t - 0.04))) + 0.05 for t in tr]
    out = DL.analyze_delay(pair_rows(spark, {"p": (list(zip(tc, command)), list(zip(tr, response))), "short": ([(0, 1)], [(0, 1), (1, 1)]),
                                             "gap": ([(0, 1), (1, 1), (2, 1), (90, 1)], [(0, 1), (1, 1), (2, 1), (90, 1)])}), K, search_range_s=0.3, tile=64 if limit == 60 else 4096, max_group_rows=limit)
    rows = {r["s"]: r for r in out.summary.collect()}
    curve = {r["k"]: r["correlation"] for r in out.curve.where("s = 'p'").collect()}
    lag, want, err = numpy_delay(np.array(tc), np.array(command), np.array(tr), np.array(response), 0.3)
    s = rows["p"]
    assert s["status"] == "Valid" and rows["short"]["status"] == "InsufficientOverlap" and rows["gap"]["status"] == "GapExceeded"
    assert s["lag_s"] == pytest.approx(lag) and s["lag_s"] == pytest.approx(0.04, abs=0.011)
    assert set(curve) == set(want) and all(curve[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert (s["mean_abs_error"], s["max_abs_error"], s["p95_abs_error"]) == pytest.approx((err.mean(), err.max(), np.quantile(err, .95)))
    assert rows["short"]["matched_events"] == 0 and rows["short"]["mean_s"] is None


@pytest.mark.parametrize("limit", LONG_LIMITS)
def test_dead_time(spark, limit):
    up = lambda edges, n: [(i * 0.01, float(sum(i >= e for e in edges) % 2)) for i in range(n)]
    pairs = pair_rows(spark, {"p": (up([20, 55, 80], 120), up([24, 60, 85], 120)), "never": (up([20], 60), [(i * 0.01, 0.0) for i in range(60)])})
    out = DL.first_response_delay(pairs, K, search_range_s=0.3, max_group_rows=limit)
    s = {r["s"]: r for r in out.summary.collect()}
    # The response crosses 2 % of its range within the step before its edge row.
    delays = [0.03 + 0.0002, 0.04 + 0.0002, 0.04 + 0.0002]
    assert (s["p"]["command_edges"], s["p"]["matched_edges"], s["p"]["rising_n"], s["p"]["falling_n"]) == (3, 3, 2, 1)
    assert s["p"]["all_mean_s"] == pytest.approx(sum(delays) / 3) and s["p"]["all_min_s"] == pytest.approx(delays[0])
    assert (s["never"]["command_edges"], s["never"]["matched_edges"], s["never"]["all_mean_s"]) == (1, 0, None)


def test_three_actuators(spark):
    limit = 2_000_000
    rows = []
    for i in range(200):
        t = i * 0.01
        x, y, yaw = math.sin(t * 4), math.cos(t * 3), math.sin(t * 5)
        for role, v in (("jx", x), ("jy", y), ("yaw", yaw), ("left", -y - yaw), ("right", -y + yaw), ("front", x)):
            rows.append(("m", role, int(i * 1e7), i, v))
    df = spark.createDataFrame(rows, "s string, role string, ts_ns long, frame_index long, value double")
    out = DL.butterfly(df, K, max_group_rows=limit)
    axes = {r["actuator"]: r for r in out.axes.collect()}
    assert set(axes) == {"Left", "Right", "Front"}
    for a in axes.values():
        assert a["correlation"] == pytest.approx(1) and a["rmse"] == pytest.approx(0, abs=1e-9) and a["gain"] == pytest.approx(1)
    track = P.track_actuators(df.withColumn("role", F.when(F.col("role") == "left", "ax").when(F.col("role") == "right", "ay").otherwise(F.col("role"))), K, max_group_rows=limit)
    assert track.vector.first()["n"] == 200 and {r["axis"] for r in track.axes.collect()} == {"X", "Y"}


def test_traffic_counts_time_faults(spark):
    rows = [("f", i, t * 1_000_000, 256, False, 8, 8, "Rx", "c", "Classic", "Receive", False) for i, t in enumerate([0, 10, 20, 15, 40])]
    df = spark.createDataFrame(rows, "source_file string, frame_index long, ts_ns long, can_id long, is_extended boolean, dlc int, payload_len int, frame_type string, "
                                     "channel string, frame_format string, direction string, brs boolean")
    c = cycle_timing(df, max_group_rows=2).first()
    assert (c["cycles"], c["negative_cycles"], c["min_cycle_ms"], c["max_cycle_ms"]) == (4, 1, pytest.approx(-5), pytest.approx(25))
    assert c["jitter_ms"] == pytest.approx(np.std([10, 10, -5, 25], ddof=1))
    o = bus_overview(df).first()
    assert (o["frames"], o["unique_streams"], o["negative_cycles"]) == (5, 1, 1)
    busy = (47 + 64 + 3) * 1.2 / 500_000
    assert o["avg_load_pct"] == pytest.approx(100 * 5 * busy / 0.04) and o["peak_frames_per_s"] == pytest.approx(50)
    assert [r["frames"] for r in bus_trend(df).orderBy("bin").collect()] == [5, 0]
