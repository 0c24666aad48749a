"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from buslens.llm.common import pick, staged
from buslens.llm.vectors import blocks, grid, numbered, unpack, usable

#: Bins of a histogram of one round.
BINS = 64
#: Rows and queries of a block.
ROWS, QUERIES = 4_096, 512
#: Rows scored at once inside a block.
STEP = 2_048
#: Below it, integers and their sums are exact as doubles.
EXACT = 2.0**53
#: The scores a long holds.
LEAST, MOST = -(2**63), 2**63 - 1


def _scores(queries: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Integer inner products as int64, exact, and 0 for pairs of a query with itself; products that a long cannot hold are refused."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if top < EXACT:
        return (queries @ rows.T).astype("int64")
    exact = [np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape) for m in (queries, rows)]
    whole = exact[0] @ exact[1].T if rows.shape[1] else np.zeros((len(queries), len(rows)), dtype=object)
    whole[own] = 0
    if whole.size and not LEAST <= whole.min() <= whole.max() <= MOST:
        raise ValueError("an inner product is beyond the range of a long")
    return whole.astype("int64")


def _parts(row) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, scores, own) in steps; own marks pairs of a query with itself."""
    ids, matrix = unpack(row)
    q_ids = np.frombuffer(row.q_ids, dtype="int64")
    q_matrix = np.frombuffer(row.q_matrix, dtype="float64").reshape(len(q_ids), row.q_dim)
    for i in range(0, len(ids), STEP):
        some = ids[i:i + STEP]
        own = q_ids[:, None] == some[None, :]
        yield q_ids, some, _scores(q_matrix, matrix[i:i + STEP], own), own


def _rows_of(batches: Iterator[pd.DataFrame]) -> Iterator:
    for pdf in batches:
        yield from pdf.itertuples(index=False)


def _arrays(row, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(getattr(row, n), dtype="int64").copy() for n in names]


def _offset(values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """values - low, as unsigned numbers: a difference of two longs may be larger than a long."""
    return values.view("uint64") - low.view("uint64")


def _width(low: np.ndarray, high: np.ndarray, n_bins: int) -> np.ndarray:
    """Width of a bin of the interval low..high, both ends included."""
    return _offset(high, low) // np.uint64(n_bins) + np.uint64(1)


def _count(k: int, n_bins: int):
    """Per cell of the grid, the counts of the bins that can hold a query's kth value: down to the one with the cell's own kth value."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows_of(batches):
            low, high = _arrays(row, "low", "high")
            width = _width(low, high, n_bins)[:, None]
            counts = np.zeros((len(low), n_bins), dtype="int64")
            at = np.arange(len(low))[:, None] * n_bins
            for _, _, scores, own in _parts(row):
                keep = (scores >= low[:, None]) & (scores <= high[:, None]) & ~own
                place = at + np.minimum(_offset(scores, low[:, None]) // width, np.uint64(n_bins - 1)).astype("int64")
                counts += np.bincount(place[keep], minlength=counts.size).reshape(counts.shape)
            beyond = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (beyond < k))
            yield pd.DataFrame({"query_block": row.query_block, "query": q, "bin": b, "count": counts[q, b]})
    return count


def _locate(k: int, n_bins: int):
    """The bin with the kth value becomes the next interval low..high; `above` counts the values beyond it. A block of queries
    is a group: at most 512 times 64 rows. An interval of one value is the kth value."""
    def locate(key, found: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        row = next(state.itertuples(index=False))
        low, high, above = _arrays(row, "low", "high", "above")
        width = _width(low, high, n_bins)
        counts = np.zeros((len(low), n_bins), dtype="int64")
        counts[found["query"], found["bin"]] = found["count"]
        reach = counts[:, ::-1].cumsum(axis=1)[:, ::-1] + above[:, None]
        bins = (reach >= k).sum(axis=1) - 1
        going = (low < high) & (bins >= 0)
        b = np.maximum(bins, 0)
        above = np.where(going, (reach - counts)[np.arange(len(low)), b], above)
        skipped = b.astype("uint64") * width
        first = np.where(going, (low.view("uint64") + skipped).view("int64"), low)
        rest = np.minimum(width - np.uint64(1), _offset(high, low) - skipped)
        # Fewer than k candidates: all of them are wanted, so the interval ends at its lower bound.
        last = np.where(going, (first.view("uint64") + rest).view("int64"), first)
        return pd.DataFrame([{"query_block": key[0], "low": first.tobytes(), "high": last.tobytes(), "above": above.tobytes(), "open": int((first < last).sum())}])
    return locate


def _pick_rows(k: int):
    """All rows above the kth value; of the rows that equal it, a cell's k smallest ids."""
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows_of(batches):
            low, = _arrays(row, "low")
            found = []
            for q_ids, ids, scores, own in _parts(row):
                q, r = np.nonzero((scores >= low[:, None]) & ~own)
                found.append(pd.DataFrame({"q": q, "query_id": q_ids[q], "vec_id": ids[r], "score": scores[q, r]}))
                both = pd.concat(found).sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                found = [both.groupby("q").head(k)]
            if found:
                yield found[0].drop(columns="q")
    return choose


def top_k(rows: DataFrame, queries: DataFrame, k: int, n_bins: int = BINS) -> DataFrame:
    """Each query's k rows of largest integer inner product: (query_id, rank, vec_id, score), exact.

    rows, queries: (id long, vector array<double> of integers). Round by round, all pairs are scored block against block into a
    histogram per query; the bin of the kth value is split into the next round's bins until it is one value wide. Then the rows at
    or above that value are kept, with ties to the smaller vec_id.

    A query's own id is no candidate. Repeated queries count once, with the smallest vector; repeated rows count each. Rows with a
    NULL id, or a vector that is NULL or holds a NULL or non-finite component, take no part; vectors of different length are not
    compared. Scores are exact over the range of a long; a pair beyond it stops the job. With fewer than k candidates all are returned; without rows or queries, none.
    """
    keep = F.col("id").isNotNull() & usable("vector")
    rows = staged(rows.where(keep), "vectors")
    queries = queries.where(keep).groupBy("id").agg(F.min("vector").alias("vector"))
    queries = staged(queries, "queries")
    spark = rows.sparkSession
    n_rows, n_queries = rows.count(), queries.count()
    r = staged(numbered(staged(blocks(rows, ROWS, n_rows), "blocks"), "row_block"), "rows")
    q = staged(numbered(staged(blocks(queries, QUERIES, n_queries), "blocks"), "query_block"), "queries")
    n_blocks = r.count()
    largest = rows.agg(F.max(F.expr("aggregate(vector, 0D, (a, x) -> a + x * x)")).alias("m")).first()["m"] or 0.0

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in _rows_of(batches):
            _, matrix = unpack(row)
            # In the norms' product; squares of very long vectors may not be finite.
            reach = np.array([min(MOST, int(x) + 2) if np.isfinite(x) else MOST for x in np.sqrt((matrix * matrix).sum(axis=1)) * largest**0.5 * (1 + 1e-9)], dtype="int64")
            low = np.where(reach == MOST, LEAST, -reach)
            yield pd.DataFrame([{"query_block": row.query_block, "low": low.tobytes(), "high": reach.tobytes(), "above": np.zeros(len(reach), "int64").tobytes(), "open": len(reach)}])

    shape = "query_block int, low binary, high binary, above binary, open long"
    state = staged(q.mapInPandas(begin, shape), "state")
    while (state.agg(F.sum("open")).first()[0] or 0) > 0:
        cells = grid(r, q.join(state, "query_block"), n_blocks)
        counts = cells.mapInPandas(_count(k, n_bins), "query_block int, query int, bin int, count long")
        counts = counts.groupBy("query_block", "query", "bin").agg(F.sum("count").alias("count"))
        state = staged(counts.groupBy("query_block").cogroup(state.groupBy("query_block")).applyInPandas(_locate(k, n_bins), shape), "state")
    found = grid(r, q.join(state, "query_block"), n_blocks).mapInPandas(_pick_rows(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_search(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """top_k over embeddings turned into floor(scale * x). Queries: rows whose vec_id is divisible by `every`."""
    rows = pick(embeddings, "vec_id", "embedding").where(usable("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"))
    return top_k(rows, rows.where(F.col("id") % every == 0), k)
