"""Two series on one time axis: interpolation, nearest rows, next changes.

Pair tables hold both sides as rows: key columns (one set per pair), side 'L' or
'R', ts_ns, frame_index, value. One job handles any number of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from buslens.functions.frame import time_s
from buslens.operators.ordered import BLOCK, Ordered, ordered
from buslens.operators.series import interval_stats
from buslens.plans.staging import MAX_GROUP_ROWS, is_large, same_keys_join, sized, staged
from buslens.schema import SERIES_ORDER

VALID, NO_OVERLAP, GAP = "Valid", "InsufficientOverlap", "GapExceeded"
TOO_LARGE = "ResourceLimitExceeded"
# Fixed rule: a gap may be five times the median interval of the slower series.
GAP_FACTOR = 5.0


@dataclass(frozen=True)
class Aligned:
    """rows: keys, ts_ns, t, left, right of the valid pairs; report: one row per pair.

    The rows are staged: every analysis reads them more than once. blocked tells
    whether some pair is too long for a single task; in_order holds the rows ready
    for row-order work by ts_ns, in the blocks that they were aligned in.
    """

    rows: DataFrame
    report: DataFrame
    blocked: bool
    in_order: Ordered


def pair_samples(samples: DataFrame, left: DataFrame, right: DataFrame, pair_cols: list[str]) -> DataFrame:
    """Rows of both sides. left and right give, per pair, the identity of one signal."""
    parts = []
    for side, refs in (("L", left), ("R", right)):
        keys = [c for c in refs.columns if c not in pair_cols]
        hit = same_keys_join(samples, sized(refs), keys)
        parts.append(hit.select(*pair_cols, F.lit(side).alias("side"), "ts_ns", "frame_index", "value"))
    return parts[0].unionByName(parts[1])


def lerp(x: Column, before: Column, after: Column) -> Column:
    """Value at x between two (t, v) structs; outside the series the nearer end holds."""
    dt = after["t"] - before["t"]
    inside = before["v"] + (after["v"] - before["v"]) * ((x - before["t"]) / dt)
    return (F.when(before.isNull(), after["v"]).when(after.isNull(), before["v"])
            .when(F.abs(dt) <= 1e-12, after["v"]).otherwise(inside))


def pair_bounds(pairs: DataFrame, keys: list[str], *, blocked: bool) -> DataFrame:
    """One row per pair: both sides' counts and intervals, the overlap, and the status."""
    stats = interval_stats(pairs, [*keys, "side"], blocked=blocked)
    names = ["n", "first_ns", "last_ns", "median_dt", "max_dt", "dup_dt"]
    wide = stats.groupBy(*keys).agg(*[
        F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{p}_{c}") for side, p in (("L", "l"), ("R", "r")) for c in names])
    c = F.col
    # greatest and least skip NULL, so a missing side is tested for explicitly.
    both = c("l_n").isNotNull() & c("r_n").isNotNull()
    wide = wide.withColumns({
        "start_ns": F.when(both, F.greatest("l_first_ns", "r_first_ns")),
        "end_ns": F.when(both, F.least("l_last_ns", "r_last_ns")),
        "slow_dt": F.greatest("l_median_dt", "r_median_dt"),
        "fine_dt": F.least("l_median_dt", "r_median_dt"),
        "worst_dt": F.greatest("l_max_dt", "r_max_dt"),
    })
    status = (F.when(~both | (c("end_ns") < c("start_ns")), NO_OVERLAP)
              .when(c("worst_dt") > GAP_FACTOR * c("slow_dt"), GAP).otherwise(VALID))
    return wide.withColumn("status", status)


def align_pairs(pairs: DataFrame, keys: list[str], *, max_group_rows: int = MAX_GROUP_ROWS) -> Aligned:
    """Both sides interpolated at every time of either, inside the common period.

    A pair whose largest gap breaks the rule yields no rows, only its report.
    """
    blocked = is_large(pairs, keys, max_group_rows)
    bounds = sized(pair_bounds(pairs, keys, blocked=blocked))
    left, right = F.col("side") == "L", F.col("side") == "R"

    def pick(agg, side):
        return agg(F.when(side, F.col("value")), F.when(side, F.col("frame_index")))

    times = pairs.groupBy(*keys, "ts_ns").agg(
        pick(F.min_by, left).alias("l_head"), pick(F.max_by, left).alias("l_tail"),
        pick(F.min_by, right).alias("r_head"), pick(F.max_by, right).alias("r_tail"),
    ).withColumn("t", time_s(F.col("ts_ns")))

    def point(v):
        return F.when(F.col(v).isNotNull(), F.struct(F.col("t").alias("t"), F.col(v).alias("v")))

    o = ordered(times, keys, ["ts_ns"], blocked=blocked, max_group_rows=max_group_rows).select(
        l=point("l_tail"), r=point("r_tail"), l_next=point("l_head"), r_next=point("r_head"))
    # Looking back, the last of equal times counts; looking ahead, the first.
    o = o.last_known(l0="l", r0="r").next_known(l1="l_next", r1="r_next")
    rows = same_keys_join(o.df, bounds.select(*keys, "start_ns", "end_ns", "l_first_ns", "r_first_ns", "slow_dt", "status"), keys)
    rows = rows.where(F.col("ts_ns").between(F.col("start_ns"), F.col("end_ns")))

    def value(s):
        # Of equal times the last row counts, but the very first time of a series gives its first row.
        own = F.when(F.col("ts_ns") == F.col(f"{s}_first_ns"), F.col(f"{s}_head")).otherwise(F.col(f"{s}_tail"))
        return F.coalesce(own, lerp(F.col("t"), F.col(f"{s}0"), F.col(f"{s}1")))

    def gap(s):
        return F.when(F.col(s).isNotNull(), 0.0).otherwise(F.coalesce(F.col(f"{s}1.t") - F.col(f"{s}0.t"), F.lit(0.0)))

    rows = rows.select(*keys, BLOCK, "ts_ns", "t", value("l").alias("left"), value("r").alias("right"), "status",
                       (F.greatest(gap("l"), gap("r")) <= GAP_FACTOR * F.col("slow_dt")).alias("covered"))
    rows = staged(rows, "aligned")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), F.count_if("covered").alias("covered"))
    valid = rows.where(F.col("status") == VALID).drop("status", "covered")
    return Aligned(valid.drop(BLOCK), _report(bounds, counts, keys), blocked, Ordered(valid, list(keys), ["ts_ns"], blocked))


def _report(bounds: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    out = same_keys_join(bounds, counts, keys, "left")
    ok = F.col("status") != NO_OVERLAP

    def or_zero(v):
        return F.when(ok, v).otherwise(0)

    limit = GAP_FACTOR * F.col("slow_dt")
    note = (F.when(F.col("l_n").isNull() | F.col("r_n").isNull(), "a series is empty")
            .when(~ok, "the series share no period")
            .when(F.col("status") == GAP, F.format_string("gap of %.6g s exceeds %.6g s", "worst_dt", limit))
            .otherwise("linear interpolation within the common period"))
    return out.select(
        *keys, "status", (F.coalesce("l_n", F.lit(0)) + F.coalesce("r_n", F.lit(0))).alias("source_rows"),
        or_zero(F.when(F.col("status") == VALID, F.col("times")).otherwise(F.col("covered"))).alias("aligned_rows"),
        or_zero(F.col("end_ns") - F.col("start_ns")).alias("overlap_ns"),
        or_zero(F.col("covered") * 100.0 / F.col("times")).cast("double").alias("coverage_pct"),
        or_zero(F.col("worst_dt")).cast("double").alias("max_sample_distance_s"),
        (F.coalesce("l_dup_dt", F.lit(0)) + F.coalesce("r_dup_dt", F.lit(0))).alias("duplicate_intervals"), note.alias("note"))


def union_times(pairs: DataFrame, keys: list[str], **opts) -> DataFrame:
    """The distinct times of both sides inside their common period."""
    blocked = is_large(pairs, keys, opts.get("max_group_rows", MAX_GROUP_ROWS))
    bounds = sized(pair_bounds(pairs, keys, blocked=blocked).select(*keys, "start_ns", "end_ns"))
    return (same_keys_join(pairs, bounds, keys).where(F.col("ts_ns").between(F.col("start_ns"), F.col("end_ns")))
            .select(*keys, "ts_ns").distinct())


def around(points: DataFrame, probes: DataFrame, keys: list[str], *, blocked: bool | None = None,
           max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Per probe the last point at or before it (before) and the first after it (after).

    points: keys, t, tie, v; probes: keys, t and any other columns.
    """
    extra = [c for c in probes.columns if c not in (*keys, "t")]
    carried = F.struct(*extra) if extra else F.struct(F.lit(1).alias("one"))
    # A point sorts before a probe of the same time: it is "at or before".
    a = points.select(*keys, "t", F.lit(0).alias("kind"), F.col("tie").cast("long").alias("tie"),
                      F.struct("t", "v").alias("p"), F.lit(None).cast(probes.select(carried.alias("x")).schema["x"].dataType).alias("x"))
    b = probes.select(*keys, "t", F.lit(1).alias("kind"), F.monotonically_increasing_id().alias("tie"),
                      F.lit(None).cast(a.schema["p"].dataType).alias("p"), carried.alias("x"))
    o = ordered(a.unionByName(b), keys, ["t", "kind", "tie"], blocked=blocked, max_group_rows=max_group_rows)
    rows = o.last_known(before="p").next_known(after="p").done().where(F.col("kind") == 1)
    return rows.select(*keys, "t", *[F.col(f"x.{c}").alias(c) for c in extra], "before", "after")


def interpolate(samples: DataFrame, probes: DataFrame, keys: list[str], **opts) -> DataFrame:
    """Add value: the series of the same keys, interpolated at each probe time t (seconds)."""
    points = samples.select(*keys, time_s(F.col("ts_ns")).alias("t"), F.col("frame_index").alias("tie"), F.col("value").alias("v"))
    head = sized(samples.groupBy(*keys).agg(
        F.min(time_s(F.col("ts_ns"))).alias("__t0"), F.min_by("value", F.struct(*SERIES_ORDER)).alias("__v0")))
    rows = same_keys_join(around(points, probes, keys, **opts), head, keys, "left")
    value = F.when(F.col("t") <= F.col("__t0"), F.col("__v0")).otherwise(lerp(F.col("t"), F.col("before"), F.col("after")))
    return rows.withColumn("value", value).drop("before", "after", "__t0", "__v0")


def nearest_sample(samples: DataFrame, probes: DataFrame, keys: list[str], **opts) -> DataFrame:
    """Add near_t, near_value and distance: the row closest in time, the earlier of two equally close.

    A series without rows gives NULL.
    """
    points = samples.select(*keys, time_s(F.col("ts_ns")).alias("t"), F.col("frame_index").alias("tie"), F.col("value").alias("v"))
    rows = around(points, probes, keys, **opts)
    back, ahead = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    use_before = F.col("after").isNull() | (back <= ahead)
    near = F.when(F.coalesce(use_before, F.lit(False)), F.col("before")).otherwise(F.col("after"))
    return rows.withColumn("near", near).withColumns({
        "near_t": F.col("near.t"), "near_value": F.col("near.v"), "distance": F.abs(F.col("near.t") - F.col("t")),
    }).drop("near", "before", "after")


def snap_time(samples: DataFrame, probes: DataFrame, keys: list[str], probe_cols: list[str], **opts) -> DataFrame:
    """Per probe the closest row over all its series; of equally close ones the first series."""
    near = nearest_sample(samples, probes, keys, **opts).where(F.col("near_t").isNotNull())
    best = F.min(F.struct("distance", *keys, "near_t", "near_value")).alias("best")
    return near.groupBy(*probe_cols).agg(best).select(*probe_cols, "best.*")


def change_times(samples: DataFrame, keys: list[str], *, eps: float = 1e-9, **opts) -> DataFrame:
    """Rows whose value differs from the row before."""
    o = ordered(samples.select(*keys, *SERIES_ORDER, "value"), keys, SERIES_ORDER, **opts).lag(prev="value")
    return o.done().where(F.abs(F.col("value") - F.col("prev")) > eps).drop("prev")


def next_change(samples: DataFrame, probes: DataFrame, keys: list[str], probe_cols: list[str], **opts) -> DataFrame:
    """Per probe the earliest change after its time, over all its series; NULL if none follows."""
    changes = change_times(samples, keys, **opts)
    points = changes.select(*keys, time_s(F.col("ts_ns")).alias("t"), F.col("frame_index").alias("tie"), F.col("value").alias("v"))
    rows = around(points, probes, keys, **opts)
    return rows.groupBy(*probe_cols).agg(F.min("after.t").alias("next_change_s"))
