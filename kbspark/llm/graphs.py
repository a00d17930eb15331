"""Connected components of an edge table, without any node's edges in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns node and root (the smallest node of its component) for every node of ``edges``
    (columns a, b: orderable, not null; either order, repeats allowed).

    Large-star and small-star steps alternate: each node links its larger neighbours, then its
    smaller ones, to the smallest neighbour. Every step groups by node with partial minima and
    joins these back, so that a node with very many edges is split like any other skewed join
    key. The number of rounds grows with the logarithm of the longest path. An empty table
    gives an empty one.
    """
    pairs = stored(_directed(edges).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        pairs = _star(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "b > a")
        pairs = stored(_star(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "b < a"), "edges")
        # Both steps keep components; nothing changes any more when the pairs stay the same.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    tips = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return tips.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _directed(edges: DataFrame) -> DataFrame:
    """Pairs with the larger node first."""
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _star(both: DataFrame, which: str) -> DataFrame:
    """Links the neighbours b of each node a that ``which`` picks to the smallest of a and its
    neighbours. A small star also links a itself. The minima are written first, so that both sides
    of the join are plain shuffles, which Spark can split where a node is hot."""
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
    linked = both.filter(which).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if which == "b < a":
        linked = linked.unionByName(least.select("a", F.col("m").alias("b")))
    return _directed(linked).distinct()
