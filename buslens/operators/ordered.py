"""Row-order operations on series of any length.

A series that fits a task is one window partition. When a group is larger, all
rows are range-partitioned by (keys, order), which also splits a single hot
series, and the partition number becomes a block: windows then run per (keys,
block), and one small row per block carries values over the block borders.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from buslens.plans.staging import MAX_GROUP_ROWS, is_large, same_keys_join, sized, staged

BLOCK = "__blk"


@dataclass(frozen=True)
class Ordered:
    df: DataFrame
    keys: list[str]
    order: list[str]
    blocked: bool

    @property
    def window(self):
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)

    @property
    def _reverse(self):
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*[F.col(c).desc() for c in self.order])

    @property
    def _blocks(self):
        return Window.partitionBy(*self.keys).orderBy(BLOCK)

    def _with(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.order, self.blocked)

    def _carry(self, per_block: DataFrame) -> DataFrame:
        return same_keys_join(self.df, sized(per_block), [*self.keys, BLOCK], "left")

    def select(self, **cols: Column) -> "Ordered":
        return self._with(self.df.withColumns(cols))

    def done(self) -> DataFrame:
        return self.df.drop(BLOCK)

    def lag(self, **cols: str) -> "Ordered":
        """new=old: the value of the previous row of the series."""
        return self._shift(cols, F.lag, F.max_by, self.window)

    def lead(self, **cols: str) -> "Ordered":
        """new=old: the value of the next row of the series."""
        return self._shift(cols, F.lead, F.min_by, self.window)

    def _shift(self, cols, shift, pick, w) -> "Ordered":
        if not self.blocked:
            return self._with(self.df.withColumns({n: shift(c).over(w) for n, c in cols.items()}))
        edge = self.df.groupBy(*self.keys, BLOCK).agg(
            pick(F.struct(*[F.col(c).alias(n) for n, c in cols.items()]), F.struct(*self.order)).alias("__e"))
        df = self._carry(edge.withColumn("__e", shift("__e").over(self._blocks)))
        at_border = shift(F.lit(True)).over(w).isNull()
        return self._with(df.withColumns({
            n: F.when(at_border, F.col(f"__e.{n}")).otherwise(shift(c).over(w)) for n, c in cols.items()
        }).drop("__e"))

    def number(self, name: str, total: str | None = None) -> "Ordered":
        """0-based position in the series, and optionally the length of the series."""
        if not self.blocked:
            new = {name: F.row_number().over(self.window).cast("long") - 1}
            if total:
                new[total] = F.count(F.lit(1)).over(Window.partitionBy(*self.keys, BLOCK))
            return self._with(self.df.withColumns(new))
        n = self.df.groupBy(*self.keys, BLOCK).agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(self._blocks.rowsBetween(Window.unboundedPreceding, -1))
        n = n.select(*self.keys, BLOCK, F.coalesce(before, F.lit(0)).alias("__before"),
                     F.sum("__n").over(Window.partitionBy(*self.keys)).alias(total or "__total"))
        df = self._carry(n).withColumn(name, F.row_number().over(self.window) - 1 + F.col("__before"))
        return self._with(df.drop("__before", "__total"))

    def running_sum(self, **cols: str) -> "Ordered":
        """new=old: the sum from the first row of the series up to this row."""
        w = self.window.rowsBetween(Window.unboundedPreceding, 0)
        inside = {n: F.sum(c).over(w) for n, c in cols.items()}
        if not self.blocked:
            return self._with(self.df.withColumns(inside))
        s = self.df.groupBy(*self.keys, BLOCK).agg(*[F.sum(c).alias(n) for n, c in cols.items()])
        outer = self._blocks.rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(s.select(*self.keys, BLOCK, *[F.coalesce(F.sum(n).over(outer), F.lit(0)).alias(f"__{n}") for n in cols]))
        return self._with(df.withColumns({n: v + F.col(f"__{n}") for n, v in inside.items()}).drop(*[f"__{n}" for n in cols]))

    def last_known(self, **cols: str) -> "Ordered":
        """new=old: the last non-null value at or before this row."""
        return self._fill(cols, self.window, F.max_by, self._blocks)

    def next_known(self, **cols: str) -> "Ordered":
        """new=old: the first non-null value at or after this row."""
        # A reversed running frame: an unbounded-following frame would be quadratic.
        blocks = Window.partitionBy(*self.keys).orderBy(F.col(BLOCK).desc())
        return self._fill(cols, self._reverse, F.min_by, blocks)

    def _fill(self, cols, w, pick, blocks) -> "Ordered":
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        inside = {n: F.last(c, ignorenulls=True).over(running) for n, c in cols.items()}
        if not self.blocked:
            return self._with(self.df.withColumns(inside))
        order = F.struct(*self.order)
        edge = self.df.groupBy(*self.keys, BLOCK).agg(*[
            pick(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(f"__{n}") for n, c in cols.items()])
        outer = blocks.rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.select(*self.keys, BLOCK, *[
            F.last(f"__{n}", ignorenulls=True).over(outer).alias(f"__{n}") for n in cols])
        df = self._carry(edge)
        return self._with(df.withColumns({n: F.coalesce(v, F.col(f"__{n}")) for n, v in inside.items()})
                          .drop(*[f"__{n}" for n in cols]))


def ordered(df: DataFrame, keys: list[str], order: list[str], *, blocked: bool | None = None,
            max_group_rows: int = MAX_GROUP_ROWS) -> Ordered:
    """Prepare a table for row-order work. (keys, order) should identify a row."""
    if blocked is None:
        blocked = is_large(df, keys, max_group_rows)
    if not blocked:
        return Ordered(df.withColumn(BLOCK, F.lit(0)), list(keys), list(order), False)
    spark = df.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // max_group_rows))
    cut = df.repartitionByRange(blocks, *keys, *order).withColumn(BLOCK, F.spark_partition_id())
    return Ordered(staged(cut, "blocks"), list(keys), list(order), True)
