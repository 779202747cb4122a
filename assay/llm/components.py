"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.session import cut_lineage


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, root) for every node that an edge touches; ``root`` is the smallest node of its component.

    Loops, repeated edges and edges with a NULL end change nothing.  Minima are
    aggregated before they are shuffled and the joins that spread them are left
    to the skew handling of adaptive execution, so a hub with most of the edges
    is split.  The number of rounds grows with the logarithm of the number of
    nodes; each round is written to the shared folder.
    """
    a, b = F.col(src), F.col(dst)
    now = cut_lineage(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = _fingerprint(now)
    while seen[0]:
        now = cut_lineage(_small_star(_large_star(now)))
        before, seen = seen, _fingerprint(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
