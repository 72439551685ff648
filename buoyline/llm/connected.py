"""Connected components of a distributed edge list by alternating star contraction.

Both sides of a join here grow with the edges, whose number Spark cannot tell
from the plan that made them. They are counted each round anyway: beyond FEW
the joins are merge joins, so that no side is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FEW = 100_000  # edges whose joins may broadcast a side: twice as many rows of two numbers at most, 5 MB


def _joined(edges: DataFrame, best: DataFrame, few: bool) -> DataFrame:
    return edges.join(best if few else best.hint("merge"), "hi")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = edges.select("hi", "lo").unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    best = both.groupBy("hi").agg(F.least(F.min("lo"), F.first("hi")).alias("best"))
    return _joined(both, best, few).where("lo > hi").select(F.col("lo").alias("hi"), F.col("best").alias("lo")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    best = edges.groupBy("hi").agg(F.min("lo").alias("best"))
    passed = _joined(edges, best, few).where("lo > best").select(F.col("lo").alias("hi"), F.col("best").alias("lo"))
    return passed.unionByName(best.select("hi", F.col("best").alias("lo"))).distinct()


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Each round contracts all components at once; the number of rounds grows
    with the logarithm of the longest chain. A round's edges are written to the
    shared checkpoint folder, so lineage stays short and a lost executor costs
    one round at most. Only a row count and a checksum reach the driver.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = pairs.distinct().checkpoint()
    before = _state(edges)
    while before[0]:
        few = before[0] <= FEW
        edges = _small_star(_large_star(edges, few), few).checkpoint()
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
