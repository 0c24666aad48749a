"""Reducing series for display. Analyses never use these."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buslens.operators.ordered import ordered
from buslens.plans.staging import MAX_GROUP_ROWS
from buslens.schema import SERIES_ORDER


def downsample_minmax(samples: DataFrame, keys: list[str], max_points: int = 4000, *, order: list[str] | None = None,
                      value: str = "value", max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Minimum and maximum of max_points/2 equal index buckets, in row order.

    A series within max_points stays whole. The earliest row wins ties; a bucket
    whose minimum and maximum are one row yields it twice.
    """
    order = order or SERIES_ORDER
    o = ordered(samples, keys, order, max_group_rows=max_group_rows).number("pos", "len").done()
    if max_points < 8:
        return o.drop("len").withColumn("slot", F.lit(0))
    buckets = max_points // 2
    width = F.col("len") / F.lit(float(buckets))
    # The bucket by division may be off by one at a border, where the borders themselves decide.
    guess = F.floor(F.col("pos") / width)
    bucket = (F.when(F.floor((guess + 1) * width) <= F.col("pos"), guess + 1)
              .when(F.floor(guess * width) > F.col("pos"), guess - 1).otherwise(guess))
    # Rounding may put the last row one bucket too far.
    bucket = F.least(bucket, F.lit(buckets - 1))
    whole = F.col("len") <= max_points
    row = F.struct("pos", *[c for c in samples.columns if c not in keys])
    rows = o.select(*keys, "pos", F.col(value).alias("__v"), row.alias("row"), F.when(whole, F.col("pos")).otherwise(bucket).alias("bucket"),
                    whole.alias("whole"))
    picked = rows.groupBy(*keys, "bucket").agg(
        F.first("whole").alias("whole"), F.min_by("row", F.struct("__v", "pos")).alias("low"),
        F.max_by("row", F.struct(F.col("__v"), -F.col("pos"))).alias("high"))
    pair = F.when(F.col("whole"), F.array("low")).otherwise(F.sort_array(F.array("low", "high")))
    return picked.select(*keys, F.posexplode(pair).alias("slot", "row")).select(*keys, "slot", "row.*")


def stride_reduce(rows: DataFrame, keys: list[str], max_points: int = 5000, *, order: list[str] | None = None,
                  max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Every ceil(n / max_points)-th row and the last one."""
    if max_points < 1:
        raise ValueError("max_points must be positive")
    m = int(max_points)
    o = ordered(rows, keys, order or SERIES_ORDER, max_group_rows=max_group_rows).number("pos", "len").done()
    step = F.ceil(F.col("len") / F.lit(float(m)))
    return o.where((F.col("pos") % step == 0) | (F.col("pos") == F.col("len") - 1)).drop("len")
