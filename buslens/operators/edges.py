"""Steps in a series, and which response step answers which command step.

Thresholds come from quantiles, candidates from lag columns. Only the greedy
part runs in Python: over sparse candidates, in slots that are worked off side
by side, however long a chain of events that depend on each other is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from buslens.operators.ordered import ordered
from buslens.operators.quantiles import grouped
from buslens.operators.scan import SLOT_ROWS, fields, in_parallel, in_slots
from buslens.plans.staging import MAX_GROUP_ROWS, is_large, same_keys_join, sized, staged


def _rows(points: DataFrame, keys: list[str], blocked: bool, max_group_rows: int):
    o = ordered(points.select(*keys, "t", "pos", "v"), keys, ["t", "pos"], blocked=blocked, max_group_rows=max_group_rows)
    o = o.lag(t0="t", v0="v").select(delta=F.col("v") - F.col("v0"))
    return o.lag(before="delta").select(
        dt=F.when(F.col("t") > F.col("t0"), F.col("t") - F.col("t0")), size=F.abs("delta"),
        quiet=F.abs(F.coalesce("before", F.lit(0.0))))


def _levels(rows: DataFrame, keys: list[str], blocked: bool, max_group_rows: int) -> DataFrame:
    points = {"p01": ("v", 0.01), "p99": ("v", 0.99), "p80": ("size", 0.80), "mid_dt": ("dt", 0.5)}
    q = grouped(rows, keys, [F.count(F.lit(1)).alias("n")], points, blocked=blocked, max_group_rows=max_group_rows)
    return q.withColumns({
        "range": F.greatest(F.lit(1e-9), F.col("p99") - F.col("p01")),
        "mid_dt": F.coalesce("mid_dt", F.lit(0.01)),
    })


def _steps(points, keys, high: Column, gap: Column, *, quiet: bool, min_rows: int, blocked, max_group_rows) -> DataFrame:
    if blocked is None:
        blocked = is_large(points, keys, max_group_rows)
    rows = _rows(points, keys, blocked, max_group_rows).done()
    # Read for the levels and for the steps: beyond one task, the order is worked out once.
    rows = staged(rows.drop("t0", "v0", "before"), "deltas") if blocked else rows
    levels = sized(_levels(rows, keys, blocked, max_group_rows).select(*keys, "n", high.alias("high"), gap.alias("gap")))
    hit = same_keys_join(rows, levels, keys).where((F.col("n") >= min_rows) & (F.col("size") >= F.col("high")) & (F.col("size") > 0))
    if quiet:
        hit = hit.where(F.col("quiet") < F.col("high") * 0.45)
    cand = hit.select(*keys, "t", "pos", "v", F.signum("delta").cast("int").alias("direction"), F.col("size").alias("magnitude"), "gap")
    # Steps are sparse; staged, the folds below read them without the series behind them.
    return staged(thin_by_gap(staged(cand, "steps"), keys).drop("gap"), "edges")


def edge_events(points: DataFrame, keys: list[str], *, window: float, blocked: bool | None = None,
                max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Steps that stand out from the noise after a quiet row. points: keys, t (seconds), pos, v."""
    w = max(0.01, float(window))
    high = F.greatest(F.lit(1e-5), F.col("range") * 0.02, F.col("p80") * 2.5)
    gap = F.greatest(F.lit(0.03), F.least(F.lit(w * 0.35), F.col("mid_dt") * 6.0))
    return _steps(points, keys, high, gap, quiet=True, min_rows=3, blocked=blocked, max_group_rows=max_group_rows)


def change_events(points: DataFrame, keys: list[str], *, fraction: float = 0.02, gap_multiplier: float = 3.0,
                  blocked: bool | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """The same steps with a chosen share of the range and gap, as drawn on a plot."""
    high = F.greatest(F.lit(1e-5), F.col("range") * min(max(fraction, 0.01), 0.5), F.col("p80") * 2.5)
    gap = F.greatest(F.lit(0.03), F.col("mid_dt") * max(3.0, float(gap_multiplier)))
    return _steps(points, keys, high, gap, quiet=True, min_rows=2, blocked=blocked, max_group_rows=max_group_rows)


def command_steps(points: DataFrame, keys: list[str], *, window: float, blocked: bool | None = None,
                  max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Steps of at least 30 % of the command's range."""
    w = max(0.01, float(window))
    gap = F.greatest(F.lit(0.02), F.least(F.lit(w * 0.5), F.col("mid_dt") * 4.0))
    return _steps(points, keys, F.col("range") * 0.30, gap, quiet=False, min_rows=2, blocked=blocked, max_group_rows=max_group_rows)


def every_nth_event(events: DataFrame, keys: list[str], max_events: int, *, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Thin events for display: every (n / max_events)-th one and the last."""
    o = ordered(events, keys, ["t", "pos"], max_group_rows=max_group_rows).number("no", "all").done()
    step = F.greatest(F.lit(1), F.floor(F.col("all") / F.lit(max_events)))
    return o.where((F.col("all") <= max_events) | (F.col("no") % step == 0) | (F.col("no") == F.col("all") - 1)).drop("no", "all")


def thin_by_gap(cand: DataFrame, keys: list[str], *, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Keep a candidate if it is at least `gap` after the last one kept.

    cand: keys, t, pos, gap (one value per key). In a slot of rows each candidate links to the next one that would be kept after it; doubling these
    links gives, for each candidate that may be the first one kept, the last one. The state between slots is the time of the last one kept.
    """
    rows, slots = in_slots(cand, keys, slot_rows=slot_rows)
    return in_parallel(rows, keys, slots, -np.inf, _kept_table, _kept_after, _keep_by_gap(keys, cand.columns), fields(cand, cand.columns)).select(*cand.columns)


def _next_kept(t: np.ndarray, gap: float) -> np.ndarray:
    """Place of the first candidate at least `gap` after each, or the end."""
    at = np.searchsorted(t, t + gap, side="left")
    # The rule compares differences, which may round differently.
    while True:
        early = (at > 0) & (t[np.maximum(at - 1, 0)] - t >= gap)
        late = (at < len(t)) & (t[np.minimum(at, len(t) - 1)] - t < gap)
        if not (early | late).any():
            break
        at = at - early + late
    return np.maximum(at, np.arange(1, len(t) + 1))


def _kept_table(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate that an earlier slot may leave as the first one kept here, the last one kept."""
    pdf = pdf.sort_values(["t", "pos"])
    t, gap = pdf["t"].to_numpy(float), float(pdf["gap"].iloc[0])
    n = len(t)
    jump = np.append(_next_kept(t, gap), n)
    last = np.arange(n + 1)
    while (jump[:n] < n).any():
        last = np.where(jump < n, last[np.minimum(jump, n)], last)
        jump = jump[jump]
    entry = min(n, int(np.count_nonzero(t - t[0] < gap)) + 1)
    return t[:entry], np.append(t[last[:entry]], gap)


def _kept_after(state: float, entries: np.ndarray | None, exits: np.ndarray | None) -> float:
    if entries is None:
        return state
    hit = np.flatnonzero(entries - state >= exits[-1])
    return float(exits[hit[0]]) if len(hit) else state


def _keep_by_gap(keys: list[str], names: list[str]):
    def run(pdf: pd.DataFrame, last: float) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "pos"])
        t, gap = pdf["t"].to_numpy(float), float(pdf["gap"].iloc[0])
        follow, keep = _next_kept(t, gap), np.zeros(len(t), dtype=bool)
        at = int(np.argmax(t - last >= gap)) if t[-1] - last >= gap else len(t)
        while at < len(t):
            keep[at] = True
            at = follow[at]
        return pdf.loc[keep, names]
    return run


def match_edges(commands: DataFrame, responses: DataFrame, keys: list[str], *, window: float, same_time: bool = False,
                slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Give each command the first unused response of its direction within the window, in time order.

    A response before an earlier command's match is spent. So all that a stretch of time hands on is how many of the next one's responses are spent. Slots are as wide as the window
    at least: commands of one see the responses of the next and no further. A slot's table holds that number for every number that the slot can start with; commands
    move all of them at once, and numbers that meet stay together.
    """
    w = max(0.01, float(window))
    # At equal times the side that sorts first is the one that must not (or may) see the other.
    rank = {"command": 0, "response": 1} if same_time else {"response": 0, "command": 1}

    def side(rows, name):
        return rows.select(*keys, "t", "pos", "direction", F.lit(rank[name]).alias("rank"), F.lit(name == "command").alias("is_command"))

    rows, slots = in_slots(side(commands, "command").unionByName(side(responses, "response")), keys, least=w * (1 + 1e-9), slot_rows=slot_rows)
    if slots > 1:
        seen = F.when(F.col("is_command") | (F.col("slot") == 0), F.array("slot")).otherwise(F.array("slot", F.col("slot") - 1))
        rows = rows.withColumn("seen", F.explode(seen)).withColumn("ahead", F.col("seen") < F.col("slot")).drop("slot").withColumnRenamed("seen", "slot")
    else:
        rows = rows.withColumn("ahead", F.lit(False))
    schema = f"{fields(rows, keys)}, command_t double, response_t double, delay_s double, direction int"
    return in_parallel(rows, keys, slots, 0.0, _spent_table(w, same_time), _spent_after, _match(keys, w, same_time), schema)


class _Sides:
    """Commands and responses of a slot in order, and for each direction the next response from each place on."""

    def __init__(self, pdf: pd.DataFrame, same_time: bool):
        pdf = pdf.sort_values(["t", "rank", "pos"])
        is_command = pdf["is_command"].to_numpy(bool)
        t, direction = pdf["t"].to_numpy(float), pdf["direction"].to_numpy()
        self.begin = t[0]
        self.tc, self.dc = t[is_command], direction[is_command].tolist()
        self.tr, dr = t[~is_command], direction[~is_command]
        self.own = int((~pdf["ahead"].to_numpy(bool)[~is_command]).sum())
        self.first = np.searchsorted(self.tr, self.tc, side="left" if same_time else "right")
        n = len(dr)
        self.next = {}
        for d in set(self.dc):
            place = np.append(np.where(dr == d, np.arange(n), n), n)
            self.next[d] = np.minimum.accumulate(place[::-1])[::-1]
        self.padded = np.append(self.tr, np.inf)


def _spent_table(window: float, same_time: bool):
    def table(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = _Sides(pdf, same_time)
        count = int(np.count_nonzero(x.tr[:x.own] - x.begin <= window)) + 1
        spent, which = np.arange(count), np.arange(count)
        for k, (tc, dc, first) in enumerate(zip(x.tc.tolist(), x.dc, x.first.tolist())):
            hit = x.next[dc][np.maximum(spent, first)]
            spent = np.where(x.padded[hit] - tc <= window, hit + 1, spent)
            if len(spent) > 1 and k % 16 == 0:
                spent, place = np.unique(spent, return_inverse=True)
                which = place[which]
        return np.arange(count), np.maximum(0, spent[which] - x.own)
    return table


def _spent_after(state: float, entries: np.ndarray | None, exits: np.ndarray | None) -> float:
    return 0.0 if exits is None else float(exits[min(int(state), len(exits) - 1)])


def _match(keys: list[str], window: float, same_time: bool):
    def run(pdf: pd.DataFrame, state: float) -> pd.DataFrame:
        x, spent, found = _Sides(pdf, same_time), int(state), []
        after, times = {d: n.tolist() for d, n in x.next.items()}, x.padded.tolist()
        for tc, dc, first in zip(x.tc.tolist(), x.dc, x.first.tolist()):
            hit = after[dc][max(spent, first)]
            if times[hit] - tc <= window:
                found.append((tc, times[hit], times[hit] - tc, dc))
                spent = hit + 1
        out = pd.DataFrame(found, columns=["command_t", "response_t", "delay_s", "direction"])
        for i, c in enumerate(keys):
            out.insert(i, c, pd.Series([pdf[c].iloc[0]] * len(out), dtype=pdf[c].dtype))
        return out
    return run


def delay_event_stats(matches: DataFrame, keys: list[str], delay: str = "delay_s", *,
                      max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Count, mean, range and 95 % point of the delays: all, rising and falling."""
    tagged = matches.select(*keys, delay, F.explode(F.array(
        F.lit("all"), F.when(F.col("direction") > 0, "rising").otherwise("falling"))).alias("edges"))
    by = [*keys, "edges"]
    base = [F.count(F.lit(1)).alias("n"), F.avg(delay).alias("mean_s"), F.min(delay).alias("min_s"), F.max(delay).alias("max_s")]
    return grouped(tagged, by, base, {"p95_s": (delay, 0.95)}, blocked=is_large(tagged, by, max_group_rows), max_group_rows=max_group_rows)


def combined_delay(stats: DataFrame, by: list[str]) -> DataFrame:
    """Several delay statistics in one: mean weighted by count, overall minimum and maximum."""
    ok = stats.where((F.col("n") > 0) & F.col("mean_s").isNotNull())
    return ok.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum(F.col("mean_s") * F.col("n")) / F.sum("n")).alias("mean_s"),
                               F.min("min_s").alias("min_s"), F.max("max_s").alias("max_s"))
