"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; ``root`` is the least node reachable, roots included.

    Loops, repeated edges and nulls are ignored. Each round links every node to the least node nearby and
    is written to the shared folder; the rounds end when nothing changes, after a number of them that
    grows with the logarithm of the longest path. A node with many links is a grouped minimum and one
    side of a join, never a list.
    """
    pairs = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    pairs = written(pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        pairs = written(_small_star(_large_star(both)))
        after = _state(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _large_star(both: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("least", "u"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    moved = pairs.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()
