"""Connected components by alternating large-star and small-star steps, as joins and aggregates.

Each step replaces an edge by one to the smallest neighbour; the number of rounds grows with the logarithm of the longest
path, edges never leave the cluster, and each round's edges are written to the shared folder. Only one number per round
(a checksum of the edges) reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.common import drop, save, spread_join


def _star(pairs: DataFrame, rows: int, label: str) -> tuple[DataFrame, str]:
    """Edges from each ``b`` of ``pairs`` (a, b) to the smallest node next to its ``a``, that of ``a`` itself too, as (a, b)."""
    low, path = save(pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n")), label)
    return spread_join(pairs, low, "a", rows), path


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); component is the smallest node reachable.

    Self-loops, repeated edges and both directions are allowed; null ends are ignored; no edges give no rows. Nodes without
    edges are not returned: they are their own component. The edges of a node with very many neighbours stay where they are
    (``spread_join``).
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e, path = save(e, label)
    state = None
    while True:
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
        # large star: greater neighbours of a node move to its smallest one
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met, low = _star(both, 2 * seen[0], label)
        large, lpath = save(met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), label)
        drop(spark, path, low)
        # small star: smaller neighbours of a node, and the node, move to the smallest one
        met, low = _star(large, seen[0], label)
        moved = met.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e, path = save(moved.union(met.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), label)
        drop(spark, lpath, low)
    return e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.col("m").alias("component")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
