"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is two aggregations by a node's smallest neighbour and joins on the node; no neighbourhood is gathered. Each
round is written to the shared folder, which cuts the lineage. The number of rounds grows with the logarithm of the nodes.
"""

from pyspark.sql import functions as F

from .common import held


def components(edges, rounds=60):
    """edges(a long, b long) -> id, component: the smallest id of the component; nodes without an edge to others are left out."""
    edges = held(_ordered(edges).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: a node's larger neighbours go to its smallest neighbour, or to itself if that is smaller
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        least = held(least, "least")
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = held(_ordered(large).distinct(), "large_star")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = held(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), "m"), "least")
        small = large.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
        edges = held(_ordered(small).distinct(), "small_star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy("a").agg(F.min("b").alias("b")).unionByName(edges.select(F.col("b").alias("a"), "b").distinct()).select(
                F.col("a").alias("id"), F.col("b").alias("component")
            )
        before = state
    raise RuntimeError(f"components are not found after {rounds} rounds")


def _ordered(edges):
    """Edges from the larger to the smaller end, without loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
