"""Approximate nearest neighbours: robust-pruned directed graphs over shards, searched with a beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from buslens.llm.common import partitions, pick, staged
from buslens.llm.vectors import blocks, grid, numbered, unpack, usable

#: Vectors of a shard, queries of a block.
SHARD, QUERIES = 4_096, 512
#: Links of a node; width of the beam when the graph is built and when it is searched; by how much pruning is relaxed.
DEGREE, BUILD_BEAM, BEAM, RELAX = 24, 48, 96, 1.2
#: Nodes of the beam that one step opens.
OPENED = 4
#: Nodes that are linked at once, at most.
BATCH = 512


def lifted(x: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all vectors are equally long: then the nearest by distance has the largest inner product.
    In double precision, as a single very long vector makes all squares as large as its own, and distances are their differences."""
    square = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(0, square.max(initial=0) - square))]).astype("float64")


def beam_search(x: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search for all queries side by side: (node numbers, squared distances), nearest first, len(x) - 1 and inf where a beam
    is not full. The last row of x stands for no node. A step opens the nearest unopened nodes of each beam."""
    none, n = len(x) - 1, len(queries)
    square, own = (x * x).sum(axis=1), (queries * queries).sum(axis=1)
    ids, dist = np.full((n, width), none), np.full((n, width), np.inf)
    opened = np.ones((n, width), dtype=bool)
    ids[:, 0], opened[:, 0] = entry, False
    dist[:, 0] = square[entry] + own - 2 * queries @ x[entry]
    seen = np.zeros((n, none + 1), dtype=bool)
    seen[:, [none, entry]] = True
    active = np.arange(n)
    while len(active):
        closed = opened[active]
        chosen = ~closed & (np.cumsum(~closed, axis=1) <= OPENED)
        row, col = np.nonzero(chosen)
        opened[active[row], col] = True
        row = np.repeat(active[row], links.shape[1])
        near = links[ids[active][chosen]].ravel()
        new = ~seen[row, near]
        code = np.unique(row[new].astype("int64") * (none + 1) + near[new])
        row, near = code // (none + 1), code % (none + 1)
        seen[row, near] = True
        found = square[near] + own[row] - 2 * np.einsum("ij,ij->i", queries[row], x[near])
        if len(row):
            first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            sizes = np.diff(np.append(first, len(row)))
            place = np.arange(len(row)) - np.repeat(first, sizes)
            rows = row[first]
            more_ids, more = np.full((len(rows), sizes.max()), none), np.full((len(rows), sizes.max()), np.inf)
            at = np.repeat(np.arange(len(rows)), sizes)
            more_ids[at, place], more[at, place] = near, found
            all_dist = np.concatenate([dist[rows], more], axis=1)
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            dist[rows] = np.take_along_axis(all_dist, order, axis=1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], more_ids], axis=1), order, axis=1)
            opened[rows] = np.take_along_axis(np.concatenate([opened[rows], more_ids == none], axis=1), order, axis=1)
        active = active[~opened[active].all(axis=1)]
    return ids, dist


def robust_prune(x: np.ndarray, near: np.ndarray, dist: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each row of candidates, nearest first: keep the nearest, drop those that it is nearer to by the factor `relax`, and so on."""
    none = len(x) - 1
    c = x[near]
    square = (c * c).sum(axis=2)
    between = relax**2 * np.maximum(0, square[:, :, None] + square[:, None, :] - 2 * c @ c.transpose(0, 2, 1))
    alive = near != none
    out, rows = np.full((len(near), degree), none), np.arange(len(near))
    for k in range(degree):
        at = alive.argmax(axis=1)
        has = alive[rows, at]
        if not has.any():
            break
        out[has, k] = near[has, at[has]]
        alive &= ~has[:, None] | (between[rows, at] > dist)
        alive[rows, at] = False
    return out


def _link_back(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, degree: int, relax: float) -> None:
    """The neighbours of `nodes` link back to them; lists that grow too long are pruned again."""
    none = len(x) - 1
    source = np.repeat(nodes, degree)
    target = links[nodes, :degree].ravel()
    ok = target != none
    source, target = source[ok], target[ok]
    order = np.lexsort((((x[source] - x[target])**2).sum(axis=1), target))
    source, target = source[order], target[order]
    own, first, sizes = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, sizes)
    held = links[own, :degree]
    wide = np.full((len(own), 2 * degree), none)
    wide[:, :degree] = held
    at = np.repeat((held != none).sum(axis=1), sizes) + place
    fits = at < 2 * degree
    again = (held[np.repeat(np.arange(len(own)), sizes)] == source[:, None]).any(axis=1)
    fits &= ~again
    wide[np.repeat(np.arange(len(own)), sizes)[fits], at[fits]] = source[fits]
    short = (wide != none).sum(axis=1) <= degree
    packed = np.sort(wide[short], axis=1)[:, :degree]  # no node sorts last
    links[own[short], :degree] = packed
    for i in range(0, int((~short).sum()), BATCH):
        some = own[~short][i:i + BATCH]
        near = wide[~short][i:i + BATCH]
        dist = np.where(near == none, np.inf, ((x[near] - x[some][:, None, :])**2).sum(axis=2))
        order = np.argsort(dist, axis=1, kind="stable")
        links[some, :degree] = robust_prune(x, np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1), degree, relax)


def _connect(x: np.ndarray, links: np.ndarray, entry: int, degree: int) -> None:
    """Nodes that no path from the entry reaches are linked from the nearest reached node with a free spare link."""
    none = len(x) - 1
    reached = np.zeros(none + 1, dtype=bool)
    reached[[entry, none]] = True

    def spread(front: np.ndarray) -> None:
        while len(front):
            near = np.unique(links[front].ravel())
            front = near[~reached[near]]
            reached[front] = True

    spread(np.array([entry]))
    while not reached.all():
        node = int(np.flatnonzero(~reached)[0])
        free = np.flatnonzero(reached[:none] & (links[:none, degree] == none))
        links[free[((x[free] - x[node])**2).sum(axis=1).argmin()], degree] = node
        reached[node] = True
        spread(np.array([node]))


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 5) -> tuple[np.ndarray, int]:
    """(links, entry) of distinct vectors. Nodes join in random order, in batches that double: a beam search in the graph so far
    proposes neighbours, robust pruning keeps diverse ones, and these link back. One spare link a node keeps all in reach."""
    n = len(x)
    links = np.full((n + 1, degree + 1), n, dtype="int64")
    padded = np.vstack([x, np.zeros((1, x.shape[1]), dtype=x.dtype)])
    entry = int(((x - x.mean(axis=0))**2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    done = 0
    while done < len(order):
        nodes = order[done:done + min(BATCH, max(1, done))]
        near, dist = beam_search(padded, links, entry, x[nodes], beam)
        links[nodes, :degree] = robust_prune(padded, near, dist, degree, relax)
        _link_back(padded, links, nodes, degree, relax)
        done += len(nodes)
    _connect(padded, links, entry, degree)
    return links, entry


def _graphs(degree: int, beam: int, relax: float):
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, matrix = unpack(row)
                distinct, node = np.unique(matrix, axis=0, return_inverse=True)
                links, entry = build_graph(lifted(distinct), degree, beam, relax)
                yield pd.DataFrame([{"row_block": row.row_block, "dim": row.dim, "ids": row.ids, "matrix": distinct.tobytes(), "node": node.astype("int64").ravel().tobytes(), "links": links.astype("int32").tobytes(), "entry": entry}])
    return build


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component in order. queries: (n, d); rows: (n, m, d)."""
    total = np.zeros(rows.shape[:2])
    for i in range(rows.shape[2]):
        total += queries[:, i, None] * rows[:, :, i]
    return total


def _search(k: int, width: int):
    """Each shard's k nearest rows for each query of a block."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, node = np.frombuffer(row.ids, dtype="int64"), np.frombuffer(row.node, dtype="int64")
                x = np.frombuffer(row.matrix, dtype="float64").reshape(-1, row.dim)
                links = np.frombuffer(row.links, dtype="int32").reshape(len(x) + 1, -1).astype("int64")
                q_ids = np.frombuffer(row.q_ids, dtype="int64")
                q = np.frombuffer(row.q_matrix, dtype="float64").reshape(len(q_ids), row.dim)
                high = lifted(x)
                near, _ = beam_search(np.vstack([high, np.zeros((1, row.dim + 1))]), links, row.entry, np.column_stack([q, np.zeros(len(q))]), width)
                score = exact_scores(q, np.vstack([x, np.zeros((1, row.dim))])[near])
                order = np.lexsort((ids, node))  # the rows of a node, smallest id first
                first = np.searchsorted(node[order], np.arange(len(x) + 1))
                held = np.append(np.minimum(np.diff(first), k + 1), 0)
                sizes = held[near].ravel()
                who = np.repeat(np.repeat(np.arange(len(q)), near.shape[1]), sizes)
                start = np.repeat(np.append(first[:-1], 0)[near].ravel(), sizes)
                place = np.arange(len(start)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                vec, points = ids[order][start + place], np.repeat(score.ravel(), sizes)
                other = vec != q_ids[who]
                who, vec, points = who[other], vec[other], points[other]
                order = np.lexsort((vec, -points, who))
                who, vec, points = who[order], vec[order], points[order]
                begin = np.searchsorted(who, np.arange(len(q)))
                keep = np.arange(len(who)) - begin[who] < k
                yield pd.DataFrame({"query_id": q_ids[who[keep]], "vec_id": vec[keep], "score": points[keep]})
    return search


def nearest(rows: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, degree: int = DEGREE, build_beam: int = BUILD_BEAM, beam: int = BEAM, relax: float = RELAX) -> DataFrame:
    """Each query's k nearest rows found, by largest inner product: (query_id, rank, vec_id, score).

    rows, queries: (id long, vector array<double>). Rows are dealt by id into shards of bounded size, and each gets a graph of
    its distinct vectors; equal vectors are one node, which gives its smallest ids. Every query is searched in every shard with a
    beam; the nodes found are scored exactly in double precision, and the shards' best are ranked, ties to the smaller vec_id.
    All rows are indexed. A shard of at most `beam` distinct vectors is found whole.

    A query's own id is no candidate. Repeated queries count once, with the smallest vector; repeated rows count each. Rows with a
    NULL id, or a vector that is NULL, zero or holds a NULL or non-finite component, take no part; vectors of different length
    are not compared. With fewer than k candidates all are returned; without rows or queries, none.
    """
    keep = F.col("id").isNotNull() & usable("vector") & F.exists("vector", lambda v: v != 0)
    rows = staged(rows.where(keep), "vectors")
    queries = staged(queries.where(keep).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    shards = staged(numbered(staged(blocks(rows, shard, rows.count()), "blocks"), "row_block"), "shards")
    n = shards.count()
    slots = max(partitions(rows.sparkSession), min(n, 10_000))
    graphs = shards.repartition(slots, "row_block").mapInPandas(_graphs(degree, build_beam, relax), "row_block int, dim int, ids binary, matrix binary, node binary, links binary, entry int")
    graphs = staged(graphs, "graphs")
    asked = staged(blocks(queries, QUERIES, queries.count()), "asked")
    found = grid(graphs, asked, n).mapInPandas(_search(k, max(beam, 2 * k)), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def embedding_search(embeddings: DataFrame, every: int = 20, k: int = 20, **options) -> DataFrame:
    """`nearest` over embeddings. Queries: rows whose vec_id is divisible by `every`."""
    rows = pick(embeddings, "vec_id", "embedding").where(usable("embedding")).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return nearest(rows, rows.where(F.col("id") % every == 0), k, **options)
