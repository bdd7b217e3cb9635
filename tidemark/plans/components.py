"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.plans.lineage import cut, parts_for

#: Edges of a partition.
EDGES = 200_000


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, files: int | None = None) -> DataFrame:
    """One row ``(node, component)`` for each node of ``edges``; component is the smallest node reachable.

    Every round links each node's larger neighbours to its smallest one, then its smaller
    neighbours to the smallest, until no edge changes. Degrees of hot nodes only meet
    aggregates with map-side combine and joins that Spark can split. Nulls and self-loops
    are ignored; an empty table gives an empty one. ``files`` is in how many files the edges are kept at first.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where("a <> b").distinct()
    e = cut(e, files)
    n = e.count()
    parts = parts_for(n, EDGES)
    if n == 0:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(max_rounds):
        # large star
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star
        s = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(s, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = cut(small.where("a <> b").distinct(), parts)  # edges only get fewer
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
