"""Analyses of aligned pairs: stick usage, density, axis tracking, vector error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from buslens.operators.align import Aligned, align_pairs, nearest_sample
from buslens.operators.ordered import Ordered, ordered
from buslens.operators.quantiles import grouped, quantiles
from buslens.operators.series import histogram, slice_time
from buslens.plans.staging import MAX_GROUP_ROWS, is_large, same_keys_join, sized, staged


@dataclass(frozen=True)
class PairAnalysis:
    """stats: one row per valid pair; path: normalised points; radius_histogram and alignment report."""

    stats: DataFrame
    path: DataFrame
    radius_histogram: DataFrame
    alignment: DataFrame


def path_center_scale(rows: DataFrame, keys: list[str], *, blocked: bool | None = None,
                      max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Medians of both sides and half of the wider 1 %..99 % range."""
    wanted = {"center_x": ("left", 0.5), "center_y": ("right", 0.5), "x01": ("left", 0.01), "x99": ("left", 0.99),
              "y01": ("right", 0.01), "y99": ("right", 0.99)}
    q = quantiles(rows, keys, wanted, blocked=blocked, max_group_rows=max_group_rows)
    wide = F.greatest(F.col("x99") - F.col("x01"), F.col("y99") - F.col("y01")) / 2.0
    return q.select(*keys, "center_x", "center_y", F.greatest(F.lit(1e-9), wide).alias("scale"))


def normalized_path(rows: DataFrame, keys: list[str], center_scale: DataFrame) -> DataFrame:
    """Aligned rows as points x, y around the centre, one unit being the scale, with their radius."""
    x = (F.col("left") - F.col("center_x")) / F.col("scale")
    y = (F.col("right") - F.col("center_y")) / F.col("scale")
    return same_keys_join(rows, center_scale, keys).withColumns({"x": x, "y": y}).withColumn(
        "radius", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).drop("center_x", "center_y", "scale")


def pair_stats(rows: DataFrame, keys: list[str], *, deadzone: float = 0.10, saturation: float = 0.90, blocked: bool | None = None,
               in_order: Ordered | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Dwell-weighted usage of aligned rows: each point counts until the next one. Returns stats and path.

    in_order: the same rows, ready for row-order work by ts_ns.
    """
    if in_order is not None:
        blocked = in_order.blocked
    if blocked is None:
        blocked = is_large(rows, keys, max_group_rows)
    cs = sized(path_center_scale(rows, keys, blocked=blocked, max_group_rows=max_group_rows))
    path = normalized_path(rows, keys, cs)
    if in_order is None:
        in_order = ordered(path, keys, ["ts_ns"], blocked=blocked, max_group_rows=max_group_rows)
    else:
        in_order = Ordered(normalized_path(in_order.df, keys, cs), in_order.keys, in_order.order, in_order.blocked)
    o = in_order.lead(next_t="t").lag(t0="t", x0="x", y0="y")
    dx, dy, dt = F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), F.col("t") - F.col("t0")
    length = F.sqrt(dx * dx + dy * dy)
    alone = F.col("next_t").isNull() & F.col("t0").isNull()
    weighted = o.select(
        weight=F.when(alone, 1.0).otherwise(F.coalesce(F.greatest(F.col("next_t") - F.col("t"), F.lit(0.0)), F.lit(0.0))),
        length=length, speed=F.when(dt > 0, length / dt)).done()
    x, y, r, w = F.col("x"), F.col("y"), F.col("radius"), F.col("weight")

    def share(test: Column) -> Column:
        return F.sum(F.when(test, w).otherwise(0.0)) / F.sum(w) * 100.0

    base = [
        F.count(F.lit(1)).alias("n"), F.greatest(F.max("t") - F.min("t"), F.lit(0.0)).alias("duration_s"),
        (F.sum(r * w) / F.sum(w)).alias("mean_radius"), F.max(r).alias("max_radius"),
        share(r <= deadzone).alias("deadzone_pct"), share(r >= saturation).alias("saturation_pct"),
        (F.sum(x * w) / F.sum(w)).alias("bias_x"), (F.sum(y * w) / F.sum(w)).alias("bias_y"),
        share((x >= 0) & (y >= 0)).alias("quadrant1_pct"), share((x < 0) & (y >= 0)).alias("quadrant2_pct"),
        share((x < 0) & (y < 0)).alias("quadrant3_pct"), share((x >= 0) & (y < 0)).alias("quadrant4_pct"),
        F.coalesce(F.sum("length"), F.lit(0.0)).alias("path_length"), F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed")]
    points = {"p95_radius": ("radius", 0.95), "x05": ("x", 0.05), "x95": ("x", 0.95), "y05": ("y", 0.05), "y95": ("y", 0.95)}
    stats = grouped(weighted, keys, base, points, blocked=blocked, max_group_rows=max_group_rows)

    def used(axis):
        return F.least(F.lit(100.0), (F.col(f"{axis}95") - F.col(f"{axis}05")) / 2.0 * 100.0)

    stats = stats.withColumns({"used_x_range_pct": used("x"), "used_y_range_pct": used("y")}).drop("x05", "x95", "y05", "y95")
    stats = same_keys_join(stats, cs, keys)
    return stats.select(*keys, "n", "duration_s", "center_x", "center_y", *[
        c for c in stats.columns if c not in (*keys, "n", "duration_s", "center_x", "center_y", "scale")]), path


def analyze_pairs(pairs: DataFrame, keys: list[str], *, deadzone: float = 0.10, saturation: float = 0.90, bins: int = 30,
                  max_group_rows: int = MAX_GROUP_ROWS) -> PairAnalysis:
    """Left is x, right is y of a stick."""
    aligned = align_pairs(pairs, keys, max_group_rows=max_group_rows)
    return _analyze(aligned, keys, deadzone, saturation, bins, max_group_rows)


def _analyze(aligned: Aligned, keys, deadzone, saturation, bins, max_group_rows) -> PairAnalysis:
    stats, path = pair_stats(aligned.rows, keys, deadzone=deadzone, saturation=saturation, in_order=aligned.in_order, max_group_rows=max_group_rows)
    hist = histogram(path, keys, "radius", bins=bins, low=F.lit(0.0))
    return PairAnalysis(stats, path, hist, aligned.report)


def joystick_usage(pairs: DataFrame, keys: list[str], *, start: float | None = None, end: float | None = None,
                   deadzone: float = 0.10, saturation: float = 0.90, bins: int = 30,
                   max_group_rows: int = MAX_GROUP_ROWS) -> PairAnalysis:
    """Normalise over the whole recording, cut the window, then analyse what is left of it.

    A pair without a point inside the window is analysed in full.
    """
    aligned = align_pairs(pairs, keys, max_group_rows=max_group_rows)
    cs = sized(path_center_scale(aligned.rows, keys, blocked=aligned.blocked, max_group_rows=max_group_rows))
    path = slice_time(normalized_path(aligned.rows, keys, cs), start, end, keys=keys, full_if_empty=True)
    both = path.withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R")))).select(
        *keys, "side", "ts_ns", F.lit(0).cast("long").alias("frame_index"),
        F.when(F.col("side") == "L", F.col("x")).otherwise(F.col("y")).alias("value"))
    again = align_pairs(both, keys, max_group_rows=max_group_rows)
    return _analyze(again, keys, max(0.0, deadzone), max(0.0, saturation), bins, max_group_rows)


def density_grid(path: DataFrame, keys: list[str], *, size: int = 64, edge: float = 1.2) -> DataFrame:
    """Points per cell of a square grid over +-edge; points outside count in the border cells."""
    def cell(c):
        at = (F.col(c) + edge) / (2.0 * edge) * size
        return F.least(F.greatest(at, F.lit(0.0)), F.lit(float(size - 1))).cast("int")

    return path.groupBy(*keys, cell("x").alias("bx"), cell("y").alias("by")).agg(
        F.count(F.lit(1)).alias("points")).withColumn("shade", F.sqrt("points"))


def axis_tracking(rows: DataFrame, keys: list[str], *, deadzone: float = 0.10, blocked: bool | None = None,
                  max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """How the right side follows the left: correlation, error, gain and offset in units of the left's range."""
    if blocked is None:
        blocked = is_large(rows, keys, max_group_rows)
    opts = {"blocked": blocked, "max_group_rows": max_group_rows}
    q = quantiles(rows, keys, {"mid": ("left", 0.5), "p01": ("left", 0.01), "p99": ("left", 0.99)}, **opts)
    cs = sized(q.select(*keys, "mid", F.greatest(F.lit(1e-9), (F.col("p99") - F.col("p01")) / 2.0).alias("half")))
    norm = same_keys_join(rows, cs, keys).select(
        *keys, ((F.col("left") - F.col("mid")) / F.col("half")).alias("c"), ((F.col("right") - F.col("mid")) / F.col("half")).alias("r"))
    norm = norm.withColumn("err", F.abs(F.col("r") - F.col("c")))
    dz, n = max(0.0, float(deadzone)), F.count(F.lit(1))
    c, r = F.col("c"), F.col("r")
    base = [
        n.alias("n"), F.avg(c).alias("mc"), F.avg(r).alias("mr"), F.var_pop(c).alias("vc"), F.var_pop(r).alias("vr"),
        F.covar_pop(c, r).alias("cov"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.avg("err").alias("mean_abs_error"), F.max("err").alias("max_abs_error"),
        (F.count_if((F.abs(c) <= dz) & (F.abs(r) > dz)) * 100.0 / n).alias("deadzone_mismatch_pct")]
    moments = grouped(norm, keys, base, {"p95_abs_error": ("err", 0.95)}, **opts)
    m = {k: F.col(k) for k in ("n", "mc", "mr", "vc", "vr", "cov")}
    spread = F.sqrt(m["n"] * m["vc"] * m["n"] * m["vr"])
    flat = (m["n"] <= 1) | (m["n"] * m["vc"] <= 1e-12)
    gain = F.when(flat, 0.0).otherwise(m["cov"] / m["vc"])
    return moments.withColumn("gain", gain).select(
        *keys, "n", F.when((m["n"] <= 1) | (spread <= 1e-12), 0.0).otherwise(m["n"] * m["cov"] / spread).alias("correlation"),
        "rmse", "gain", F.when(m["n"] <= 1, 0.0).otherwise(m["mr"] - F.col("gain") * m["mc"]).alias("offset"),
        "mean_abs_error", "max_abs_error", "deadzone_mismatch_pct", "p95_abs_error")


@dataclass(frozen=True)
class Tracking:
    """axes: one row per pair set and axis; vector: error of the whole movement; histogram and both paths."""

    axes: DataFrame
    vector: DataFrame
    vector_histogram: DataFrame
    command_path: DataFrame
    actuator_path: DataFrame


def track_actuators(signals: DataFrame, keys: list[str], *, deadzone: float = 0.10, bins: int = 40,
                    max_group_rows: int = MAX_GROUP_ROWS) -> Tracking:
    """signals: keys, role in (jx, jy, ax, ay), ts_ns, frame_index, value.

    Sets of which an axis does not align get zero statistics and no path.
    """
    opts = {"max_group_rows": max_group_rows}

    def pair(left, right):
        side = F.when(F.col("role") == left, "L").when(F.col("role") == right, "R")
        return signals.withColumn("side", side).where("side is not null").select(*keys, "side", "ts_ns", "frame_index", "value")

    axis_keys = [*keys, "axis"]
    per_axis = pair("jx", "ax").withColumn("axis", F.lit("X")).unionByName(pair("jy", "ay").withColumn("axis", F.lit("Y")))
    axes = align_pairs(per_axis, axis_keys, **opts)
    usable = sized(axes.report.groupBy(*keys).agg(F.count_if(F.col("aligned_rows") > 0).alias("ok"),
                                                  F.count_if((F.col("status") == "Valid")).alias("valid"))
                   .where("valid = 2 and ok = 2").select(*keys))
    stats = axis_tracking(same_keys_join(axes.rows, usable, keys), axis_keys, deadzone=deadzone, blocked=axes.blocked, **opts)
    every = axes.report.select(*axis_keys)
    stats = same_keys_join(every, stats, axis_keys, "left").fillna(0, [c for c in stats.columns if c not in axis_keys])

    sticks, actuators = align_pairs(pair("jx", "jy"), keys, **opts), align_pairs(pair("ax", "ay"), keys, **opts)
    stick, actuator = (same_keys_join(a.rows, usable, keys) for a in (sticks, actuators))
    blocked = sticks.blocked or actuators.blocked
    cs = sized(path_center_scale(stick, keys, blocked=blocked, **opts))
    stick_path = normalized_path(stick, keys, cs)
    actuator_path = normalized_path(actuator, keys, cs)
    vector, hist = vector_error(stick_path, actuator_path, keys, bins=bins, blocked=blocked, **opts)
    return Tracking(stats, vector, hist, stick_path, actuator_path)


def vector_errors(command_path: DataFrame, actuator_path: DataFrame, keys: list[str], *, blocked: bool | None = None,
                  max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Distance of every command point to the actuator point nearest in time; NULL without one."""
    target = actuator_path.select(*keys, "ts_ns", F.lit(0).cast("long").alias("frame_index"), F.struct("x", "y").alias("value"))
    probes = command_path.select(*keys, "t", "x", "y")
    near = nearest_sample(target, probes, keys, blocked=blocked, max_group_rows=max_group_rows)
    dx, dy = F.col("x") - F.col("near_value.x"), F.col("y") - F.col("near_value.y")
    return near.select(*keys, "t", F.sqrt(dx * dx + dy * dy).alias("error"))


def vector_error(command_path: DataFrame, actuator_path: DataFrame, keys: list[str], *, bins: int = 40, blocked: bool | None = None,
                 max_group_rows: int = MAX_GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Mean, 95 % point and maximum of the vector errors, and their histogram."""
    errors = staged(vector_errors(command_path, actuator_path, keys, blocked=blocked, max_group_rows=max_group_rows), "errors")
    if blocked is None:
        blocked = is_large(errors, keys, max_group_rows)
    base = [F.count("error").alias("n"), F.avg("error").alias("mean_error"), F.max("error").alias("max_error")]
    stats = sized(grouped(errors, keys, base, {"p95_error": ("error", 0.95), "p99_error": ("error", 0.99)}, blocked=blocked,
                          max_group_rows=max_group_rows))
    hist = histogram(errors, keys, "error", bins=bins, low=F.lit(0.0), high=F.greatest(F.lit(1.0), F.col("p99_error")),
                     bounds=stats.select(*keys, "p99_error"))
    return stats.drop("p99_error"), hist
