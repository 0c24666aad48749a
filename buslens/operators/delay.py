"""Command and response: lag by correlation, delays of single steps, dead time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.frame import time_s
from buslens.operators.align import GAP, NO_OVERLAP, TOO_LARGE, VALID, align_pairs, interpolate, pair_bounds
from buslens.operators.edges import command_steps, delay_event_stats, edge_events, match_edges
from buslens.operators.ordered import ordered
from buslens.operators.quantiles import grouped, quantiles
from buslens.operators.series import histogram, normalized_value
from buslens.operators.tiles import TILE, lag_sums
from buslens.plans.staging import MAX_GROUP_ROWS, is_large, same_keys_join, sized, staged

GRID_CHUNK = 65_536


@dataclass(frozen=True)
class Delay:
    """summary: one row per pair (with status); curve, step matches, their statistics and histogram; the grid."""

    summary: DataFrame
    curve: DataFrame
    matches: DataFrame
    event_stats: DataFrame
    histogram: DataFrame
    grid: DataFrame


def grid_bounds(pairs: DataFrame, keys: list[str], *, max_points: int | None = None,
                max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per pair: the common period on the finer median interval, or why there is none. max_points: longer grids are refused."""
    b = pair_bounds(pairs, keys, blocked=is_large(pairs, keys, max_group_rows))
    start, end = time_s(F.col("start_ns")), time_s(F.col("end_ns"))
    b = b.withColumns({"start_s": start, "end_s": end}).withColumn(
        "points", F.greatest(F.lit(3), F.ceil((F.col("end_s") - F.col("start_s")) / F.greatest(F.lit(1e-9), F.col("fine_dt"))) + 1))
    status = (F.when(F.col("start_ns").isNull() | (F.col("l_n") < 2) | (F.col("r_n") < 2) | (F.col("end_ns") <= F.col("start_ns")), NO_OVERLAP)
              .when(F.col("status") == GAP, GAP).when(F.col("points") > max_points if max_points is not None else F.lit(False), TOO_LARGE).otherwise(VALID))
    return b.withColumn("status", status).withColumn("dt", (F.col("end_s") - F.col("start_s")) / (F.col("points") - 1))


def _needs_blocks(bounds: DataFrame, max_group_rows: int) -> bool:
    """Whether some pair with its grid is too long for a task; bounds is small and staged."""
    biggest = bounds.agg(F.max(F.coalesce("points", F.lit(0)) + F.coalesce("l_n", F.lit(0)) + F.coalesce("r_n", F.lit(0)))).first()[0]
    return (biggest or 0) > max_group_rows


def grid_resample(pairs: DataFrame, keys: list[str], bounds: DataFrame, *, blocked: bool | None = None,
                  max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Both sides of the valid pairs interpolated on the uniform grid: keys, i, t, left, right."""
    ok = bounds.where(F.col("status") == VALID).select(*keys, "start_s", "dt", "points")
    chunks = ok.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("points") - 1) / GRID_CHUNK))))
    first = F.col("chunk") * GRID_CHUNK
    grid = chunks.withColumn("i", F.explode(F.sequence(first, F.least(first + GRID_CHUNK, F.col("points")) - 1)))
    grid = grid.select(*keys, "i", (F.col("start_s") + F.col("i") * F.col("dt")).alias("t"))
    sided = grid.withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    values = interpolate(same_keys_join(pairs, ok.select(*keys), keys), sided, [*keys, "side"], blocked=blocked, max_group_rows=max_group_rows)
    return values.groupBy(*keys, "i", "t").agg(
        F.max(F.when(F.col("side") == "L", F.col("value"))).alias("left"), F.max(F.when(F.col("side") == "R", F.col("value"))).alias("right"))


def smoothed_derivative(o, value: str, name: str, dt: Column):
    """First difference per dt, averaged over three rows except at both ends. o: Ordered rows with i and points."""
    o = o.lag(**{f"{name}_v0": value})
    o = o.select(**{f"{name}_d": F.when(F.col("i") == 0, 0.0).otherwise((F.col(value) - F.col(f"{name}_v0")) / dt)})
    o = o.lag(**{f"{name}_d0": f"{name}_d"}).lead(**{f"{name}_d1": f"{name}_d"})
    d0, d, d1 = F.col(f"{name}_d0"), F.col(f"{name}_d"), F.col(f"{name}_d1")
    end = (F.col("i") == 0) | (F.col("i") == F.col("points") - 1) | (F.col("points") < 3)
    return o.select(**{name: F.when(end, d).otherwise((d0 + d + d1) / 3.0)})


def lag_curve(rows: DataFrame, keys: list[str], reach: DataFrame, tile: int = TILE) -> DataFrame:
    """Correlation of left with the shifted right for every lag of -reach..reach rows.

    rows: keys, i (without gaps), a, b; reach: keys, reach. The work is cut into tiles of rows and of lags (see `lag_sums`).
    """
    total = lag_sums(rows, keys, reach, tile)
    n = F.col("n")
    ma, mb = F.col("sa") / n, F.col("sb") / n
    spread2 = (F.col("saa") / n - ma * ma) * (F.col("sbb") / n - mb * mb)
    den = F.sqrt(F.greatest(F.lit(0.0), spread2))
    corr = F.when((n <= 1) | (den <= 1e-12), 0.0).otherwise((F.col("sab") / n - ma * mb) / den)
    return total.select(*keys, F.col("k").cast("int").alias("k"), "n", corr.alias("correlation"))


def threshold_crossing(rows: DataFrame, keys: list[str], value: str, level: Column, *, blocked: bool | None = None,
                       max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per series the time of its first rise through the level, interpolated. rows carry i and t."""
    o = ordered(rows, keys, ["i"], blocked=blocked, max_group_rows=max_group_rows).lag(t0="t", v0=value)
    v, v0, t, t0 = F.col(value), F.col("v0"), F.col("t"), F.col("t0")
    at = F.when(F.abs(v - v0) <= 1e-12, t).otherwise(t0 + (t - t0) * ((level - v0) / (v - v0)))
    return o.done().where((v0 < level) & (v >= level)).groupBy(*keys).agg(F.min_by(at, F.col("i")).alias("crossing_s"))


def delay_by_threshold(rows: DataFrame, keys: list[str], fraction: float = 0.2, **opts) -> DataFrame:
    """Response minus command time of the first rise through a fraction of each side's range. rows: i, t, c, r."""
    f = min(max(float(fraction), 0.01), 0.99)
    span = sized(rows.groupBy(*keys).agg(*[x.alias(n) for n, x in {
        "c_lo": F.min("c"), "c_hi": F.max("c"), "r_lo": F.min("r"), "r_hi": F.max("r")}.items()]))
    joined = same_keys_join(rows, span, keys)
    c = threshold_crossing(joined, keys, "c", F.col("c_lo") + (F.col("c_hi") - F.col("c_lo")) * f, **opts)
    r = threshold_crossing(joined, keys, "r", F.col("r_lo") + (F.col("r_hi") - F.col("r_lo")) * f, **opts)
    both = same_keys_join(span.select(*keys), c.withColumnRenamed("crossing_s", "c_s"), keys, "left")
    both = same_keys_join(both, r.withColumnRenamed("crossing_s", "r_s"), keys, "left")
    return both.select(*keys, (F.col("r_s") - F.col("c_s")).alias("threshold_delay_s"))


def collect_delays(rows: DataFrame, keys: list[str], *, window: float, command: str = "c", response: str = "r",
                   position: str = "i", blocked: bool | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Matched steps of command and response on one time axis. rows: keys, t, position, command, response."""
    if blocked is None:
        blocked = is_large(rows, keys, max_group_rows)

    def points(c):
        return rows.select(*keys, "t", F.col(position).alias("pos"), F.col(c).alias("v"))

    opts = {"window": window, "blocked": blocked, "max_group_rows": max_group_rows}
    return match_edges(edge_events(points(command), keys, **opts), edge_events(points(response), keys, **opts), keys,
                       window=window)


def delay_histogram(delays: DataFrame, keys: list[str], *, bins: int, floor: float, column: str = "delay_s",
                    max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Counts over 0..max(floor, 99 % point)."""
    p99 = quantiles(delays, keys, {"p99": (column, 0.99)}, max_group_rows=max_group_rows)
    return histogram(delays, keys, column, bins=bins, low=F.lit(0.0), high=F.greatest(F.lit(floor), F.col("p99")), bounds=p99)


def analyze_delay(pairs: DataFrame, keys: list[str], *, search_range_s: float = 1.5, threshold_fraction: float = 0.2,
                  max_points: int | None = None, tile: int = TILE, max_group_rows: int = MAX_GROUP_ROWS) -> Delay:
    """Left is the command, right the response.

    The lag is the shift with the largest correlation of the smoothed derivatives;
    of equal ones the most negative. A positive lag means a late response.
    """
    reach_s = max(0.01, float(search_range_s))
    opts = {"max_group_rows": max_group_rows}
    bounds = sized(grid_bounds(pairs, keys, max_points=max_points, **opts))
    blocked = _needs_blocks(bounds, max_group_rows)
    raw = staged(grid_resample(pairs, keys, bounds, blocked=blocked, **opts), "grid")
    q = quantiles(raw, keys, {"c01": ("left", 0.01), "c99": ("left", 0.99), "r01": ("right", 0.01), "r99": ("right", 0.99)}, blocked=blocked, **opts)

    def middle(side):
        return (F.col(f"{side}01") + F.col(f"{side}99")) * 0.5, F.greatest(F.lit(1e-9), (F.col(f"{side}99") - F.col(f"{side}01")) * 0.5)

    cs = sized(q.select(*keys, *[x.alias(f"{side}{name}") for side in "cr" for name, x in zip(("c", "scale"), middle(side))]))
    grid = same_keys_join(same_keys_join(raw, cs, keys), bounds.select(*keys, "dt", "points"), keys)
    grid = grid.withColumns({"c": normalized_value(F.col("left"), F.col("cc"), F.col("cscale")),
                             "r": normalized_value(F.col("right"), F.col("rc"), F.col("rscale"))})
    o = ordered(grid, keys, ["i"], blocked=blocked, **opts)
    step = F.greatest(F.lit(1e-9), F.col("dt"))
    o = smoothed_derivative(smoothed_derivative(o, "c", "a", step), "r", "b", step)
    reach = F.least(F.greatest(F.bround(F.lit(reach_s) / F.greatest(F.lit(1e-9), F.col("dt"))).cast("long"), F.lit(1)),
                    F.greatest(F.lit(1), F.col("points") - 2))
    reaches = sized(bounds.where(F.col("status") == VALID).select(*keys, reach.alias("reach")))
    curve = sized(same_keys_join(lag_curve(o.done(), keys, reaches, tile), bounds.select(*keys, "dt"), keys)
                  .withColumn("lag_s", F.col("k") * F.col("dt")))
    # The largest |correlation| first, then the smallest k.
    best = sized(curve.groupBy(*keys).agg(F.max_by(F.struct("k", "lag_s", "correlation"), F.struct(F.abs("correlation"), -F.col("k"))).alias("b"))
                 .select(*keys, F.col("b.lag_s").alias("lag_s"), F.col("b.correlation").alias("correlation")))
    errors = shifted_errors(pairs, grid, keys, best, bounds, blocked=blocked, **opts)
    errors = staged(errors, "errors") if blocked else errors
    base = [F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_abs_error"), F.max("error").alias("max_abs_error")]
    err = grouped(errors, keys, base, {"p95_abs_error": ("error", 0.95)}, blocked=blocked, **opts)
    matches = staged(collect_delays(grid, keys, window=reach_s, blocked=blocked, **opts), "matches")
    stats = delay_event_stats(matches, keys, **opts)
    threshold = delay_by_threshold(grid, keys, threshold_fraction, blocked=blocked, **opts)
    row = bounds.select(*keys, "status")
    for part in (err, best, threshold, stats.where(F.col("edges") == "all").drop("edges").select(
            *keys, F.col("n").alias("matched_events"), "mean_s", "min_s", "max_s", "p95_s")):
        row = same_keys_join(row, part, keys, "left")
    row = row.withColumn("search_range_s", F.lit(reach_s)).fillna(
        0, ["n", "lag_s", "correlation", "mean_abs_error", "max_abs_error", "p95_abs_error", "matched_events"])
    return Delay(row, curve, matches, stats, delay_histogram(matches, keys, bins=30, floor=0.1, **opts), grid)


def shifted_response(pairs: DataFrame, grid: DataFrame, keys: list[str], best: DataFrame, bounds: DataFrame, **opts) -> DataFrame:
    """The response moved back by the lag: its value at t + lag, where the response has one."""
    ends = bounds.select(*keys, time_s(F.col("r_first_ns")).alias("r_first"), time_s(F.col("r_last_ns")).alias("r_last"))
    rows = same_keys_join(same_keys_join(grid, best.select(*keys, "lag_s"), keys), ends, keys)
    moved = rows.withColumn("grid_t", F.col("t")).withColumn("t", F.col("t") + F.col("lag_s"))
    moved = moved.where(F.col("t").between(F.col("r_first"), F.col("r_last")))
    response = pairs.where(F.col("side") == "R")
    out = interpolate(response, moved.select(*keys, "t", "grid_t", "i", "c", "rc", "rscale"), keys, **opts)
    return out.drop("t").withColumnRenamed("grid_t", "t")


def shifted_errors(pairs, grid, keys, best, bounds, **opts) -> DataFrame:
    moved = shifted_response(pairs, grid, keys, best, bounds, **opts)
    return moved.select(*keys, F.abs(normalized_value(F.col("value"), F.col("rc"), F.col("rscale")) - F.col("c")).alias("error"))


@dataclass(frozen=True)
class DeadTime:
    """summary: edges, matches and dead-time statistics per pair; responses: one row per command step."""

    summary: DataFrame
    responses: DataFrame
    histogram: DataFrame


def first_response(pairs: DataFrame, keys: list[str], *, search_range_s: float = 1.5, fraction: float = 0.02,
                   max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per command step the time until the response leaves its resting value.

    dead_time_s is NULL where the response does not get past the threshold within
    the range, or gets there across a gap of more than five slow intervals.
    """
    w, frac = max(0.01, float(search_range_s)), min(max(float(fraction), 0.001), 0.5)
    opts = {"max_group_rows": max_group_rows}
    blocked = is_large(pairs, keys, max_group_rows)
    bounds = sized(pair_bounds(pairs, keys, blocked=blocked))
    command, response = pairs.where(F.col("side") == "L"), pairs.where(F.col("side") == "R")
    q = quantiles(response, keys, {"p01": ("value", 0.01), "p99": ("value", 0.99)}, blocked=blocked, **opts)
    level = F.greatest(F.lit(1e-9), F.greatest(F.lit(1e-9), F.col("p99") - F.col("p01")) * frac)
    limits = sized(same_keys_join(q.select(*keys, level.alias("level")), bounds.where(
        (F.col("l_n") >= 2) & (F.col("r_n") >= 2)).select(*keys, (F.col("slow_dt") * 5.0).alias("max_gap")), keys))
    points = command.select(*keys, time_s(F.col("ts_ns")).alias("t"), F.col("frame_index").alias("pos"), F.col("value").alias("v"))
    steps = command_steps(points, keys, window=w, blocked=blocked, **opts).select(*keys, "t", "pos", "direction")
    base = interpolate(response, steps, keys, blocked=blocked, **opts).withColumnRenamed("value", "baseline")
    edges = same_keys_join(base, limits, keys).withColumn("target", F.col("baseline") + F.col("direction") * F.col("level"))
    edges = edges.select(*keys, F.col("t").alias("edge_t"), F.col("pos").alias("edge_pos"), "direction", "baseline", "target", "max_gap")

    o = ordered(response.select(*keys, "ts_ns", "frame_index", "value").withColumn("t", time_s(F.col("ts_ns"))), keys,
                ["ts_ns", "frame_index"], blocked=blocked, **opts).lag(t0="t", v0="value")
    near = o.done().select(*keys, "t", "value", "t0", "v0", "frame_index", F.floor(F.col("t") / w).alias("slot"))
    # An edge only meets the responses of the one or two slots that its range touches.
    slots = F.sequence(F.floor(F.col("edge_t") / w), F.floor((F.col("edge_t") + w) / w))
    met = same_keys_join(near, edges.withColumn("slot", F.explode(slots)), [*keys, "slot"])
    crossed = F.when(F.col("direction") > 0, F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    met = met.where((F.col("t") > F.col("edge_t")) & (F.col("t") - F.col("edge_t") <= w) & crossed)
    first = met.groupBy(*keys, "edge_t", "edge_pos").agg(
        F.min_by(F.struct("t", "value", "t0", "v0"), F.struct("t", "frame_index")).alias("hit"))
    out = same_keys_join(edges, first, [*keys, "edge_t", "edge_pos"], "left")
    t0 = F.greatest(F.col("edge_t"), F.coalesce("hit.t0", F.col("edge_t")))
    v0 = F.when(t0 == F.col("edge_t"), F.col("baseline")).otherwise(F.col("hit.v0"))
    span, rise = F.col("hit.t") - t0, F.col("hit.value") - v0
    part = F.when(F.abs(rise) <= 1e-15, 1.0).otherwise(F.least(F.greatest((F.col("target") - v0) / rise, F.lit(0.0)), F.lit(1.0)))
    dead = t0 + span * part - F.col("edge_t")
    ok = F.col("hit").isNotNull() & ~((F.col("max_gap") > 0) & (span > F.col("max_gap"))) & (dead >= 0)
    return out.select(*keys, F.col("edge_t").alias("command_t"), "direction", F.when(ok, dead).alias("dead_time_s"))


def first_response_delay(pairs: DataFrame, keys: list[str], *, search_range_s: float = 1.5, fraction: float = 0.02,
                         bins: int = 30, max_group_rows: int = MAX_GROUP_ROWS) -> DeadTime:
    opts = {"max_group_rows": max_group_rows}
    responses = staged(first_response(pairs, keys, search_range_s=search_range_s, fraction=fraction, **opts), "responses")
    found = responses.where(F.col("dead_time_s").isNotNull())
    stats = delay_event_stats(found, keys, "dead_time_s", **opts)
    counts = responses.groupBy(*keys).agg(F.count(F.lit(1)).alias("command_edges"), F.count("dead_time_s").alias("matched_edges"))
    every = pairs.select(*keys).distinct()
    summary = same_keys_join(every, counts, keys, "left").fillna(0, ["command_edges", "matched_edges"])
    for edges in ("all", "rising", "falling"):
        part = stats.where(F.col("edges") == edges).select(*keys, *[
            F.col(c).alias(f"{edges}_{c}") for c in ("n", "mean_s", "min_s", "max_s", "p95_s")])
        summary = same_keys_join(summary, part, keys, "left").fillna(0, [f"{edges}_n"])
    hist = delay_histogram(found, keys, bins=bins, floor=0.02, column="dead_time_s", **opts)
    return DeadTime(summary, responses, hist)


@dataclass(frozen=True)
class Butterfly:
    """axes, delays and histograms per actuator (Left, Right, Front); aligned: the command and actuator overlays."""

    axes: DataFrame
    delays: DataFrame
    histogram: DataFrame
    aligned: DataFrame


def butterfly(signals: DataFrame, keys: list[str], *, deadzone: float = 0.10, search_range_s: float = 1.5, bins: int = 24,
              max_group_rows: int = MAX_GROUP_ROWS) -> Butterfly:
    """Three actuators driven by one stick.

    signals: keys, role in (jx, jy, yaw, left, right, front), ts_ns, frame_index, value.
    Expected movement: Left = -Y - Yaw, Right = -Y + Yaw, Front = X.
    """
    from buslens.operators.pairs import axis_tracking

    opts = {"max_group_rows": max_group_rows}
    role = F.col("role")

    def sided(left, right):
        side = F.when(role == left, "L").when(role == right, "R")
        return signals.withColumn("side", side).where("side is not null").select(*keys, "side", "ts_ns", "frame_index", "value")

    stick = align_pairs(sided("jy", "yaw"), keys, **opts).rows
    y, yaw = F.col("left"), F.col("right")
    moves = F.explode(F.array(F.struct(F.lit("Left").alias("actuator"), (-y - yaw).alias("value")),
                              F.struct(F.lit("Right").alias("actuator"), (-y + yaw).alias("value"))))
    turned = stick.select(*keys, "ts_ns", moves.alias("m")).select(
        *keys, "m.actuator", "ts_ns", F.lit(0).cast("long").alias("frame_index"), "m.value")
    front = signals.where(role == "jx").select(*keys, F.lit("Front").alias("actuator"), "ts_ns", "frame_index", "value")
    commands = turned.unionByName(front).withColumn("side", F.lit("L"))
    actuator = F.when(role == "left", "Left").when(role == "right", "Right").when(role == "front", "Front")
    actual = signals.withColumn("actuator", actuator).where("actuator is not null").select(
        *keys, "actuator", "ts_ns", "frame_index", "value", F.lit("R").alias("side"))
    by = [*keys, "actuator"]
    aligned = align_pairs(commands.unionByName(actual), by, **opts)
    rows = aligned.rows
    axes = axis_tracking(rows, by, deadzone=deadzone, blocked=aligned.blocked, **opts)
    axes = same_keys_join(aligned.report.select(*by), axes, by, "left").fillna(0, [c for c in axes.columns if c not in by])
    matches = staged(collect_delays(rows, by, window=max(0.01, search_range_s), command="left", response="right",
                                    position="ts_ns", blocked=aligned.blocked, **opts), "matches")
    return Butterfly(axes, delay_event_stats(matches, by, **opts), delay_histogram(matches, by, bins=bins, floor=0.01, **opts), rows)
