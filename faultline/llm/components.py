"""Connected components of a table of links, by alternating star steps."""

from pyspark.sql import functions as F

from faultline.llm.base import stage

#: Steps before giving up; a graph of n nodes needs about log(n) squared.
MAX_STEPS = 60


def _large_star(edges):
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges):
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _mark(edges):
    return edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)
    ).first()


def roots(edges):
    """(node, root) for every node of the links (a, b): the smallest node reachable.

    Links and direction may repeat.  Each step ends in a written table, so lost
    executors cost one step at most.  A node's neighbours are never gathered: steps
    are minima and joins, whose hot keys Spark can split.
    """
    pointed = edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    edges = stage(pointed.distinct(), "star")
    before = _mark(edges)
    for _ in range(MAX_STEPS):
        if not before[0]:
            break
        edges = stage(_small_star(_large_star(edges).distinct()).distinct(), "star")
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
