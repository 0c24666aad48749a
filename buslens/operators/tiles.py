"""Sums of products of two series over many lags, tile against tile in the frequency domain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from buslens.plans.staging import same_keys_join

#: Rows of a tile.
TILE = 65_536
#: A product from the transform is kept if its rounding error is below this share of what it can reach at most.
PRECISION = 1e-11
SUMS = ("n", "sa", "sb", "sab", "saa", "sbb")


def _fields(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)


def lag_sums(rows: DataFrame, keys: list[str], reach: DataFrame, tile: int = TILE) -> DataFrame:
    """Per key and lag k of -reach..reach: the number of pairs (a at i, b at i + k) and their sums, also of squares and products.

    rows: keys, i (without gaps), a, b; reach: keys, reach. Each series is cut into tiles of fixed length. A tile of a meets each tile of b that lies within the reach, as
    far as the reach goes, in a group of two slices: no group grows with the series or with the reach. Products come from one transform per group, single sums from
    running sums over the slices; Spark adds the groups up per lag.
    """
    data = same_keys_join(rows.select(*keys, "i", "a", "b"), reach.select(*keys, F.col("reach").cast("long").alias("reach")), keys)
    fields = _fields(rows, keys)
    tiles = data.withColumn("tile", F.floor(F.col("i") / tile)).groupBy(*keys, "tile").applyInPandas(_packed(keys), f"{fields}, tile long, reach long, first long, n long, a binary, b binary")
    far = F.ceil(F.col("reach") / tile)
    near = F.explode(F.sequence(F.col("tile") - far, F.col("tile") + far))
    met = tiles.withColumn("met", near)
    low, high = F.greatest(F.col("first"), F.col("met") * tile - F.col("reach")), F.least(F.col("first") + F.col("n"), (F.col("met") + 1) * tile + F.col("reach"))
    met = met.withColumns({"low": low, "high": high}).where("low < high")

    def slices(side: str, at: str, other: str) -> DataFrame:
        data = F.expr(f"substring({side}, cast((low - first) * 8 + 1 as int), cast((high - low) * 8 as int))")
        return met.select(*keys, F.col(at).alias("tile_a"), F.col(other).alias("tile_b"), F.lit(side).alias("side"), "reach", "low", data.alias("data"))

    both = slices("a", "tile", "met").unionByName(slices("b", "met", "tile"))
    sums = both.groupBy(*keys, "tile_a", "tile_b").applyInPandas(_pair_sums(keys), f"{fields}, k long, n long, sa double, sb double, sab double, saa double, sbb double")
    return sums.groupBy(*keys, "k").agg(*[F.sum(c).alias(c) for c in SUMS])


def _packed(keys: list[str]):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        row = pdf.iloc[[0]][[*keys, "tile", "reach"]].copy()
        row["first"], row["n"] = int(pdf["i"].iloc[0]), len(pdf)
        for c in "ab":
            row[c] = [pdf[c].to_numpy("float64").tobytes()]
        return row
    return pack


def _pair_sums(keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [*keys, "k", *SUMS]
        if len(pdf) < 2:
            return pd.DataFrame({c: pd.Series(dtype=pdf[c].dtype if c in keys else "float64") for c in shape})
        sides = {r.side: r for r in pdf.itertuples(index=False)}
        (a, a_at), (b, b_at) = ((np.frombuffer(sides[s].data, "float64"), int(sides[s].low)) for s in "ab")
        reach = int(pdf["reach"].iloc[0])
        # b at place x + s meets a at place x.
        shift = np.arange(max(-reach + a_at - b_at, 1 - len(a)), min(reach + a_at - b_at, len(b) - 1) + 1)
        out = pd.DataFrame({"k": shift - (a_at - b_at), **products(a, b, shift)})
        for c in keys:
            out[c] = pdf[c].iloc[0]
        return out[shape]
    return run


def _range_sums(x: np.ndarray, begin: np.ndarray, length: np.ndarray, whole: int) -> np.ndarray:
    """Sums of x[begin:begin + length]. Each range starts or ends with x or has the length `whole`, so no sum is a difference of larger ones."""
    up = np.concatenate([[0.0], np.cumsum(x)])
    down = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    out = np.where(begin == 0, up[length], down[begin])
    inner = (begin > 0) & (begin + length < len(x))
    if inner.any():
        # Blocks of the range's length: a range is the end of one and the start of the next.
        rows = np.concatenate([x, np.zeros(-len(x) % whole + whole)]).reshape(-1, whole)
        heads = np.concatenate([np.zeros((len(rows), 1)), np.cumsum(rows, axis=1)], axis=1)
        tails = np.concatenate([np.cumsum(rows[:, ::-1], axis=1)[:, ::-1], np.zeros((len(rows), 1))], axis=1)
        row, place = np.divmod(begin[inner], whole)
        out[inner] = tails[row, place] + np.where(place > 0, heads[row + 1, place], 0.0)
    return out


def products(a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> dict[str, np.ndarray]:
    """SUMS over a[x], b[x + s] for each shift s at which they overlap."""
    begin = np.maximum(0, -shift)
    length = np.minimum(len(a), len(b) - shift) - begin
    at = begin + shift
    size = 1 << int(len(a) + len(b) - 1).bit_length()
    around = np.fft.irfft(np.conj(np.fft.rfft(a, size)) * np.fft.rfft(b, size), size)
    sab = around[shift % size]
    saa, sbb = _range_sums(a * a, begin, length, len(b)), _range_sums(b * b, at, length, len(a))
    # The transform's error goes with the largest rows of the tiles; where the overlap holds small ones only, the products are added up plainly.
    most = np.sqrt(saa * sbb)
    error = 4e-16 * size.bit_length() * np.sqrt((a @ a) * (b @ b))
    sab[most == 0] = 0.0
    for i in np.flatnonzero((most > 0) & (error > PRECISION * most)):
        sab[i] = a[begin[i]:begin[i] + length[i]] @ b[at[i]:at[i] + length[i]]
    return {"n": length, "sa": _range_sums(a, begin, length, len(b)), "sb": _range_sums(b, at, length, len(a)), "sab": sab, "saa": saa, "sbb": sbb}
