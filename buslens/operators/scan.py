"""Step-by-step rules over long series, in parallel: slots, a table per slot of what comes out for what goes in, and a scan over the tables.

A rule that takes its rows one after the other, such as keeping an event that is far enough from the last one kept, is a chain of any length. But what one stretch of
rows does to all later ones is a small function: from the state before the stretch to the state behind it. Slots of rows work their functions out side by side, the scan
passes the true state through one small row per slot, and then all slots run the rule, again side by side, from the state they really start with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from buslens.plans.staging import same_keys_join, sized, staged

#: Rows of a slot, in the mean over its series.
SLOT_ROWS = 65_536


def in_slots(rows: DataFrame, keys: list[str], t: str = "t", least: float = 0.0, slot_rows: int = SLOT_ROWS) -> tuple[DataFrame, int]:
    """Adds `slot` (long, from 0): equal stretches of time, `least` wide at least. Also gives the largest number of slots of a series, 0 without rows."""
    spans = rows.groupBy(*keys).agg(F.min(t).alias("__t0"), F.max(t).alias("__t1"), F.count(F.lit(1)).alias("__n"))
    parts = F.greatest(F.lit(1.0), F.ceil(F.col("__n") / slot_rows))
    width = F.greatest((F.col("__t1") - F.col("__t0")) / parts, F.lit(float(least)))
    spans = sized(spans.select(*keys, "__t0", F.when(F.col("__n") > slot_rows, width).alias("__width"), (F.col("__t1") - F.col("__t0")).alias("__span")))
    slots = spans.agg(F.max(F.when(F.col("__width") > 0, F.floor(F.col("__span") / F.col("__width")) + 1).otherwise(1))).first()[0]
    slot = F.when(F.col("__width") > 0, F.floor((F.col(t) - F.col("__t0")) / F.col("__width"))).otherwise(0).cast("long")
    return same_keys_join(rows, spans, keys).withColumn("slot", slot).drop("__t0", "__width", "__span"), int(slots or 0)


def fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def scanned(tables: DataFrame, keys: list[str], first: float, step: Callable) -> DataFrame:
    """(keys, slot, state): the state that each slot starts with. tables: keys, slot, entries (binary, doubles), exits (binary, doubles).

    step(state, entries, exits) gives the state behind a slot; without a table, behind slots that hold no rows. One row per slot flows through, as a sorted stream.
    """
    schema = f"{fields(tables, keys)}, slot long, state double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, last = None, first, None
        for pdf in batches:
            names, states = list(zip(*[pdf[k].tolist() for k in keys])) if keys else [()] * len(pdf), []
            for now, slot, entries, exits in zip(names, pdf["slot"].tolist(), pdf["entries"].tolist(), pdf["exits"].tolist()):
                if now != key:
                    key, state, last = now, first, None
                state = state if last is None or slot == last + 1 else step(state, None, None)
                states.append(state)
                state, last = step(state, np.frombuffer(entries, "float64"), np.frombuffer(exits, "float64")), slot
            yield pdf[[*keys, "slot"]].assign(state=states)

    return tables.repartition(*keys).sortWithinPartitions(*keys, "slot").mapInPandas(run, schema)


def in_parallel(rows: DataFrame, keys: list[str], slots: int, first: float, table: Callable, step: Callable, rule: Callable, out: str) -> DataFrame:
    """Run `rule(pdf, state)` on each (keys, slot) of `rows`, as if the slots of a series were run one after the other from the state `first`.

    table(pdf) gives (entries, exits), sorted by entry: which state comes out for each that can come in. rule gives a frame in the shape `out`, keys first.
    """
    if slots <= 1:
        return rows.groupBy(*keys).applyInPandas(lambda pdf: rule(pdf, first), out)

    def tabled(pdf: pd.DataFrame) -> pd.DataFrame:
        entries, exits = table(pdf)
        row = pdf.iloc[[0]][[*keys, "slot"]].copy()
        row["entries"], row["exits"] = [np.asarray(entries, "float64").tobytes()], [np.asarray(exits, "float64").tobytes()]
        return row

    rows = staged(rows, "slots")
    tables = rows.groupBy(*keys, "slot").applyInPandas(tabled, f"{fields(rows, keys)}, slot long, entries binary, exits binary")
    states = sized(scanned(tables, keys, first, step))
    started = same_keys_join(rows, states.select(*keys, "slot", F.col("state").alias("__state")), [*keys, "slot"])
    return started.groupBy(*keys, "slot").applyInPandas(lambda pdf: rule(pdf, float(pdf["__state"].iloc[0])), out)
