"""Statistics of signal series. All functions take samples and the key columns that identify a series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from buslens.functions.frame import time_s
from buslens.operators.frames import within_time
from buslens.operators.ordered import Ordered, ordered
from buslens.operators.quantiles import grouped, quantiles
from buslens.plans.staging import MAX_GROUP_ROWS, is_large, same_keys_join, sized, staged
from buslens.schema import SERIES_ORDER


def series_rows(samples: DataFrame, keys: list[str], *, blocked: bool | None = None,
                max_group_rows: int = MAX_GROUP_ROWS) -> Ordered:
    """The series in (time, frame) order with t in seconds and the previous row's time and value."""
    rows = samples.select(*keys, *SERIES_ORDER, "value").withColumn("t", time_s(F.col("ts_ns")))
    o = ordered(rows, keys, SERIES_ORDER, blocked=blocked, max_group_rows=max_group_rows)
    return o.lag(prev_t="t", prev_v="value")


def deltas_slopes(samples: DataFrame, keys: list[str], **opts) -> DataFrame:
    """Step to the previous row: dt (never negative), delta, and slope where time moved on."""
    dt = F.col("t") - F.col("prev_t")
    return series_rows(samples, keys, **opts).select(
        dt=F.greatest(dt, F.lit(0.0)), delta=F.col("value") - F.col("prev_v"),
        slope=F.when(dt > 0, (F.col("value") - F.col("prev_v")) / dt)).done()


def signal_stats(samples: DataFrame, keys: list[str], *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Count, duration, range, mean, population deviation, median, 1 % and 99 % points, first and last value."""
    v, t = F.col("value"), time_s(F.col("ts_ns"))
    at = F.struct(*SERIES_ORDER)
    base = [F.count(F.lit(1)).alias("n"), (F.max(t) - F.min(t)).alias("duration_s"), F.min(v).alias("minimum"),
            F.max(v).alias("maximum"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
            F.min_by(v, at).alias("first_value"), F.max_by(v, at).alias("last_value")]
    points = {"median": ("value", 0.5), "p01": ("value", 0.01), "p99": ("value", 0.99)}
    out = grouped(samples, keys, base, points, blocked=is_large(samples, keys, max_group_rows), max_group_rows=max_group_rows)
    return out.withColumn("net_change", F.col("last_value") - F.col("first_value"))


def event_stats(samples: DataFrame, keys: list[str], *, threshold: float | Column = 0.0, change_threshold: float = 0.01,
                max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Crossings of the threshold, time above it, changes, steps and slopes.

    Each row's state holds until the next row, so time above counts the intervals
    that start above; the longest run joins neighbouring ones.
    """
    blocked = is_large(samples, keys, max_group_rows)
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    safe = max(0.0, float(change_threshold))
    o = series_rows(samples, keys, blocked=blocked, max_group_rows=max_group_rows)
    o = o.select(above=F.col("value") >= thr, was_above=F.col("prev_v") >= thr,
                 dt=F.greatest(F.col("t") - F.col("prev_t"), F.lit(0.0)),
                 step=F.abs(F.col("value") - F.col("prev_v")))
    # A new run begins where the state that held over the interval differs from the one before it.
    o = o.lag(before="was_above").select(
        flip=F.when(F.col("was_above").eqNullSafe(F.col("before")), 0).otherwise(1)).running_sum(run="flip")
    rows = o.done().where(F.col("prev_v").isNotNull())
    d, dt = F.col("step"), F.col("dt")
    up, down = ~F.col("was_above") & F.col("above"), F.col("was_above") & ~F.col("above")
    slope = F.when(dt > 0, d / dt)
    per_run = rows.groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(up).alias("up"), F.count_if(down).alias("down"),
        F.count_if((d > 0) & (d >= safe)).alias("chg"), F.count_if(d <= 1e-12).alias("flat"), F.sum(dt).alias("total"),
        F.coalesce(F.sum(F.when(F.col("was_above"), dt)), F.lit(0.0)).alias("above"), F.sum(d).alias("sum_d"), F.max(d).alias("max_d"),
        F.sum(slope).alias("sum_s"), F.count(slope).alias("n_s"), F.max(slope).alias("max_s"))
    out = per_run.groupBy(*keys).agg(
        F.sum("up").alias("rising"), F.sum("down").alias("falling"), F.sum("chg").alias("changes"),
        F.when(F.sum("total") <= 1e-9, 0.0).otherwise(F.sum("above") / F.sum("total") * 100.0).alias("above_pct"),
        F.max("above").alias("longest_above_s"), (F.sum("sum_d") / F.sum("n")).alias("mean_abs_delta"),
        F.max("max_d").alias("max_abs_delta"), F.coalesce(F.sum("sum_s") / F.nullif(F.sum("n_s"), F.lit(0)), F.lit(0.0)).alias("mean_abs_slope"),
        F.coalesce(F.max("max_s"), F.lit(0.0)).alias("max_abs_slope"), (F.sum("flat") / F.sum("n") * 100.0).alias("flat_pct"))
    p95 = quantiles(rows, keys, {"p95_abs_delta": ("step", 0.95)}, blocked=blocked, max_group_rows=max_group_rows)
    out = same_keys_join(out, p95, keys)
    # A series of one row has no steps: all its figures are zero.
    every = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).drop("n_rows")
    return same_keys_join(every, out, keys, "left").fillna(0, [c for c in out.columns if c not in keys])


def histogram(rows: DataFrame, keys: list[str], value: str = "value", *, bins: int = 40, low: Column | None = None,
              high: Column | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Equal-width counts, empty bins included; the last bin is closed.

    low and high are expressions over vmin and vmax of the group and over the
    columns of bounds (one row per group); the range always widens to the data.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    n = int(bins)
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    span = rows.groupBy(*keys).agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    if bounds is not None:
        span = same_keys_join(span, bounds, keys, "left")
    lo = F.least(low if low is not None else F.col("vmin"), F.col("vmin"))
    hi = F.greatest(high if high is not None else F.col("vmax"), F.col("vmax"))
    span = span.withColumns({"lo": lo, "hi": hi}).withColumn("flat", F.col("hi") <= F.col("lo"))
    span = span.withColumns({
        "lo": F.when(F.col("flat"), F.col("vmin")).otherwise(F.col("lo")),
        "hi": F.when(F.col("flat"), F.when(F.col("vmax") > F.col("vmin"), F.col("vmax")).otherwise(F.col("vmin") + 1.0))
        .otherwise(F.col("hi")),
    })
    span = sized(span.select(*keys, "lo", ((F.col("hi") - F.col("lo")) / n).alias("w")))
    at = F.floor((F.col("v") - F.col("lo")) / F.col("w")).cast("int")
    counts = same_keys_join(rows, span, keys).groupBy(
        *keys, F.least(F.greatest(at, F.lit(0)), F.lit(n - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = span.select(*keys, "lo", "w", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    start = F.col("lo") + F.col("bin") * F.col("w")
    return same_keys_join(grid, counts, [*keys, "bin"], "left").select(
        *keys, "bin", start.alias("bin_start"), (start + F.col("w")).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("count"))


def delta_histogram(samples: DataFrame, keys: list[str], *, bins: int = 40, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    return histogram(deltas_slopes(samples, keys, max_group_rows=max_group_rows), keys, "delta", bins=bins)


def cdf(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative share over the bins of a histogram (at most 200 rows per series)."""
    w = Window.partitionBy(*keys)
    so_far = F.sum("count").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumn("cumulative_pct", so_far * 100.0 / F.sum("count").over(w))


@dataclass(frozen=True)
class SignalAnalysis:
    """Statistics, event statistics and both histograms, one row per series (and bin)."""

    stats: DataFrame
    events: DataFrame
    histogram: DataFrame
    delta_histogram: DataFrame


def analyze_signals(samples: DataFrame, keys: list[str], *, bins: int = 40, threshold: float = 0.0, change_threshold: float = 0.01,
                    delta_bins: int = 40, max_group_rows: int = MAX_GROUP_ROWS) -> SignalAnalysis:
    """Everything about single signals."""
    return SignalAnalysis(
        signal_stats(samples, keys, max_group_rows=max_group_rows),
        event_stats(samples, keys, threshold=threshold, change_threshold=change_threshold, max_group_rows=max_group_rows),
        histogram(samples, keys, bins=bins), delta_histogram(samples, keys, bins=delta_bins, max_group_rows=max_group_rows))


def rank_signals(samples: DataFrame, keys: list[str], *, change_threshold: float = 0.01, top_n: int = 20,
                 max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The most active series: changes per second, spread and steepest slope in one score."""
    change = max(0.0, float(change_threshold))
    rows = deltas_slopes(samples, keys, max_group_rows=max_group_rows)
    step = F.abs("delta")
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.lit(1e-9), F.max("t") - F.min("t")).alias("duration_s"),
        (F.max("value") - F.min("value")).alias("value_range"), F.stddev_pop("value").alias("std"),
        F.count_if(step >= change).alias("changes"), F.coalesce(F.max(step), F.lit(0.0)).alias("max_abs_delta"),
        F.coalesce(F.max(F.abs("slope")), F.lit(0.0)).alias("max_abs_slope")).where(F.col("n") >= 2)
    out = out.withColumn("changes_per_s", F.col("changes") / F.col("duration_s"))
    # Fixed weights of the score.
    score = F.col("changes_per_s") * 0.60 + F.col("std") * 0.25 + F.col("max_abs_slope") * 0.15
    return out.withColumn("score", score).orderBy(F.desc("score"), *keys).limit(top_n)


def interval_stats(samples: DataFrame, keys: list[str], *, blocked: bool | None = None,
                   max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per series: rows, first and last time, median and largest positive interval, equal consecutive times."""
    if blocked is None:
        blocked = is_large(samples, keys, max_group_rows)
    dt = time_s(F.col("ts_ns")) - time_s(F.col("prev_ns"))
    o = ordered(samples.select(*keys, *SERIES_ORDER), keys, SERIES_ORDER, blocked=blocked, max_group_rows=max_group_rows).lag(prev_ns="ts_ns")
    rows = o.select(dt=F.when(dt > 0, dt), same=(F.col("ts_ns").isNotNull() & (dt == 0)).cast("long")).done().select(*keys, "ts_ns", "dt", "same")
    # Read for the sums and for the median: beyond one task, the order is worked out once.
    rows = staged(rows, "intervals") if blocked else rows
    base = [F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
            F.coalesce(F.max("dt"), F.lit(0.0)).alias("max_dt"), F.coalesce(F.sum("same"), F.lit(0)).alias("dup_dt")]
    out = grouped(rows, keys, base, {"median_dt": ("dt", 0.5)}, blocked=blocked, max_group_rows=max_group_rows)
    # A series without a positive interval counts as sampled every 10 ms.
    return out.withColumn("median_dt", F.coalesce("median_dt", F.lit(0.01)))


def slice_time(samples: DataFrame, start: float | None = None, end: float | None = None, *,
               keys: list[str] | None = None, full_if_empty: bool = False) -> DataFrame:
    """Rows inside the window, both ends included; reversed ends are swapped.

    full_if_empty keeps a whole series of which nothing lies inside.
    """
    if start is not None and end is not None and start > end:
        start, end = end, start
    if not full_if_empty:
        return within_time(samples, start, end)
    t, inside = time_s(F.col("ts_ns")), F.lit(True)
    if start is not None:
        inside = inside & (t >= float(start))
    if end is not None:
        inside = inside & (t <= float(end))
    seen = sized(samples.groupBy(*keys).agg(F.max(inside).alias("any_inside")))
    return same_keys_join(samples, seen, keys).where(~F.col("any_inside") | inside).drop("any_inside")


def count_visible(samples: DataFrame, keys: list[str], start: float | None = None, end: float | None = None) -> DataFrame:
    return slice_time(samples, start, end).groupBy(*keys).agg(F.count(F.lit(1)).alias("visible"))


def choose_resolution(samples: DataFrame, keys: list[str], *, start: float | None = None, end: float | None = None,
                      limit: int = 200_000) -> DataFrame:
    """Visible rows per series and whether it can be shown in full."""
    return count_visible(samples, keys, start, end).withColumn("must_reduce", F.col("visible") > limit)


def transform_series(samples: DataFrame, keys: list[str], *, offsets: DataFrame | None = None, normalize: bool = False,
                     start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows of the window with the series' offset added, then optionally scaled to 0..1 (a flat series to 0)."""
    rows = slice_time(samples, start, end)
    if offsets is not None:
        rows = same_keys_join(rows, sized(offsets.select(*keys, F.col("offset").alias("__off"))), keys, "left")
        rows = rows.withColumn("value", F.col("value") + F.coalesce("__off", F.lit(0.0))).drop("__off")
    if not normalize:
        return rows
    span = sized(rows.groupBy(*keys).agg(F.min("value").alias("__lo"), F.max("value").alias("__hi")))
    width = F.col("__hi") - F.col("__lo")
    scaled = F.when(F.abs(width) < 1e-12, 0.0).otherwise((F.col("value") - F.col("__lo")) / width)
    return same_keys_join(rows, span, keys).withColumn("value", scaled).drop("__lo", "__hi")


def robust_center_scale(rows: DataFrame, keys: list[str], value: str = "value", *, blocked: bool | None = None,
                        max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Middle and half width of the 1 %..99 % range."""
    q = quantiles(rows, keys, {"p01": (value, 0.01), "p99": (value, 0.99)}, blocked=blocked, max_group_rows=max_group_rows)
    return q.select(*keys, ((F.col("p01") + F.col("p99")) * 0.5).alias("center"),
                    F.greatest(F.lit(1e-9), (F.col("p99") - F.col("p01")) * 0.5).alias("scale"))


def normalized_value(value: Column, center: Column, scale: Column, limit: float = 3.0) -> Column:
    """Distance from the centre in scales, held within +-limit; a value that is no number counts as 0."""
    x = (value - center) / scale
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.least(F.greatest(x, F.lit(-limit)), F.lit(limit))).otherwise(0.0)


def robust_normalize(samples: DataFrame, keys: list[str], *, limit: float = 3.0, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add norm: the value by its series' robust centre and scale. limit 3 for analysis, 1.2 for overlays."""
    cs = sized(robust_center_scale(samples, keys, max_group_rows=max_group_rows))
    return same_keys_join(samples, cs, keys).withColumn(
        "norm", normalized_value(F.col("value"), F.col("center"), F.col("scale"), limit)).drop("center", "scale")


def scale_to_reference(source: DataFrame, reference: DataFrame, keys: list[str], *, invert: bool = False,
                       max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Add scaled: the source mapped to the 1 %..99 % range of the reference with the same keys."""
    a = robust_center_scale(source, keys, max_group_rows=max_group_rows)
    b = robust_center_scale(reference, keys, max_group_rows=max_group_rows).select(
        *keys, F.col("center").alias("ref_center"), F.col("scale").alias("ref_scale"))
    both = sized(same_keys_join(a, b, keys))
    x = (F.col("value") - F.col("center")) / F.col("scale")
    return same_keys_join(source, both, keys).withColumn(
        "scaled", F.col("ref_center") + (-x if invert else x) * F.col("ref_scale")).drop(
        "center", "scale", "ref_center", "ref_scale")
