"""Exact interpolated quantiles per group: position q * (n - 1) between sorted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from buslens.operators.ordered import ordered
from buslens.plans.staging import MAX_GROUP_ROWS, is_large, same_keys_join, sized, staged

#: Of percentile_approx, which only says where to look for an exact quantile.
ACCURACY = 10_000


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], *,
              blocked: bool | None = None, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """wanted: output name -> (value column, q). One row per group; NULL values are left out."""
    if blocked is None:
        blocked = is_large(df, keys, max_group_rows)
    if not blocked:
        return _in_groups(df, keys, [], wanted)
    types = df.select(*[c for c, _ in wanted.values()]).schema
    parts = [_near(df, keys, {n: (c, q) for n, (c, q) in wanted.items() if types[c].dataType == kind}, max_group_rows)
             for kind in dict.fromkeys(f.dataType for f in types)]
    return reduce(lambda a, b: same_keys_join(a, b, keys, "left"), parts)


def grouped(df: DataFrame, keys: list[str], aggs: list[Column], wanted: dict[str, tuple[str, float]], *, blocked: bool,
            max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Aggregates and quantiles of the same groups, in one pass where groups fit a task."""
    if not blocked:
        return _in_groups(df, keys, aggs, wanted)
    return same_keys_join(df.groupBy(*keys).agg(*aggs), quantiles(df, keys, wanted, blocked=True, max_group_rows=max_group_rows), keys)


def _in_groups(df: DataFrame, keys: list[str], aggs: list[Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One value buffer for each column, whatever the number of its quantiles."""
    places = {c: [n for n, (own, _) in wanted.items() if own == c] for c in dict.fromkeys(c for c, _ in wanted.values())}
    found = [F.percentile(c, F.array(*[F.lit(float(wanted[n][1])) for n in names])).alias(f"__q_{c}") for c, names in places.items()]
    out = df.groupBy(*keys).agg(*aggs, *found)
    at = {n: F.get(F.col(f"__q_{c}"), F.lit(places[c].index(n))) for n, (c, _) in wanted.items()}
    return out.withColumns(at).drop(*[f"__q_{c}" for c in places])


def _near(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], max_group_rows: int, accuracy: int = ACCURACY,
          slack: float = 2.0) -> DataFrame:
    """Quantiles of groups that no single task could hold, columns of one type. One row per group.

    An approximation brackets each quantile. The rows below the bracket are counted and those inside ranked, so the values
    found are exact and only a few rows move. A quantile outside its bracket is ranked among all values.
    """
    names, edge = {c: [n for n in wanted if wanted[n][0] == c] for c in dict.fromkeys(c for c, _ in wanted.values())}, slack / accuracy
    around = {c: [min(max(wanted[n][1] + s, 0.0), 1.0) for n in own for s in (-edge, edge)] for c, own in names.items()}
    rows = df.select(*keys, *names)
    groups = sized(rows.groupBy(*keys).agg(*[x for c in names for x in (
        F.count(c).alias(f"__n_{c}"), F.percentile_approx(c, F.array(*map(F.lit, around[c])), F.lit(accuracy)).alias(f"__p_{c}"))]))

    def place(name):
        c, q = wanted[name]
        i = 2 * names[c].index(name)
        below = F.lit(q - edge > 0) & (F.col(c) < F.get(f"__p_{c}", F.lit(i)))
        above = F.lit(q + edge < 1) & (F.col(c) > F.get(f"__p_{c}", F.lit(i + 1)))
        # Rows below a bracket are one level without a value, which sorts first.
        return F.when(F.col(c).isNotNull() & ~above, F.struct(F.lit(name).alias("__q"), F.when(~below, F.col(c)).alias("__v")))

    each = same_keys_join(rows, groups, keys).select(*keys, F.explode(F.array(*map(place, wanted))).alias("__e")).where("__e is not null")
    levels = staged(each.groupBy(*keys, "__e.__q", "__e.__v").agg(F.count(F.lit(1)).alias("__c")), "levels")
    ranked = same_keys_join(ordered(levels, [*keys, "__q"], ["__v"], max_group_rows=max_group_rows).running_sum(__to="__c").done(), groups, keys)
    ranked = ranked.withColumn("__from", F.col("__to") - F.col("__c")).where(F.col("__v").isNotNull())
    found = []
    for name, (c, q) in wanted.items():
        pos = F.lit(float(q)) * (F.col(f"__n_{c}") - 1)
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("__q") == name) & (F.col("__from") <= at) & (at < F.col("__to"))
            found.append(F.max(F.when(hit, F.col("__v"))).alias(f"__{side}_{name}"))
    out = staged(same_keys_join(groups, ranked.groupBy(*keys).agg(*found), keys, "left"), "quantiles")
    missed = {n: (F.col(f"__n_{c}") > 0) & (F.col(f"__lo_{n}").isNull() | F.col(f"__hi_{n}").isNull()) for n, (c, _) in wanted.items()}
    counts = out.agg(*[F.count_if(m).alias(n) for n, m in missed.items()]).first()
    picked = []
    for name, (c, q) in wanted.items():
        pos = F.lit(float(q)) * (F.col(f"__n_{c}") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        picked.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    out = out.select(*keys, *picked)
    again = [n for n in wanted if counts[n]]
    for c in dict.fromkeys(wanted[n][0] for n in again):
        mine = {n: wanted[n][1] for n in again if wanted[n][0] == c}
        out = same_keys_join(out.drop(*mine), _ranked(df, keys, c, mine, max_group_rows), keys, "left")
    return out.select(*keys, *wanted)


def _ranked(df, keys, column, qs, max_group_rows) -> DataFrame:
    """Quantiles of groups that no single task could hold.

    Equal values are counted together first, so a quantised signal shrinks to its
    distinct levels; what is left is ranked by block-wise running sums.
    """
    levels = staged(df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__c")), "levels")
    o = ordered(levels, keys, [column], max_group_rows=max_group_rows).running_sum(__to="__c")
    size = sized(levels.groupBy(*keys).agg(F.sum("__c").alias("__n")))
    ranked = same_keys_join(o.df, size, keys).withColumn("__from", F.col("__to") - F.col("__c"))

    def at(pos):
        return (F.col("__from") <= pos) & (pos < F.col("__to"))

    picks, out = {}, []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        picks[f"__lo_{name}"], picks[f"__hi_{name}"] = at(F.floor(pos)), at(F.ceil(pos))
        frac = pos - F.floor(pos)
        out.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * frac).alias(name))
    hit = reduce(lambda a, b: a | b, picks.values())
    return (ranked.where(hit).groupBy(*keys)
            .agg(F.max("__n").alias("__n"), *[F.max(F.when(c, F.col(column))).alias(n) for n, c in picks.items()])
            .select(*keys, *out))
