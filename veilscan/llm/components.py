"""Connected components of an undirected edge table, by alternating stars.

Every round links each node to the smallest node of its neighbourhood, first from above and
then from below; the number of rounds grows with the logarithm of the longest path. Edges are
rows throughout: neighbourhoods are only ever reduced to their minimum, which combines
map-side, so a node that half of all edges touch is no burden. Each round is written to the
shared folder and read again, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilscan.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"))
    linked = down.join(least, "n")
    return (
        linked.select(F.col("m").alias("a"), F.col("s").alias("b")).filter("a < b")
        .unionByName(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
        .distinct()
    )


def component_labels(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) for every node that has an
    edge to another node. ``edges`` has long columns ``a`` and ``b``; self-edges, repeated
    edges, either direction and nulls are allowed (an edge with a null end links nothing)."""
    now = materialise(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
            )
        mark = seen
        after = materialise(_small_star(_large_star(now)), "edges")
        discard(now)
        now = after
