"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from buslens.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a long, b long); component is the smallest node reached.

    Alternating star steps: each node hands its smallest neighbour to its larger neighbours, then to its smaller ones, until every
    node hangs on its component's smallest node. The rounds grow with the logarithm of the longest path. Each round is two joins
    on a minimum per node, written to the shared folder; a node with many neighbours is only ever counted, never collected.
    """
    a, b = F.col("a"), F.col("b")
    edges = staged(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == mark:
            break
        mark = now
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.where("b > a").join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = staged(moved.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    return edges.select(a.alias("node"), b.alias("component")).unionByName(edges.select(b.alias("node"), b.alias("component")).distinct())
