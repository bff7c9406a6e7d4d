"""Connected components of a link table: alternating large-star and small-star rounds.

Every round is two aggregations and joins over written tables; nothing is
gathered on the driver but one changed-or-not flag.  The number of rounds grows
with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.llm.common import written


def _relink(pairs: DataFrame) -> DataFrame:
    """(node, low): every node of ``pairs`` (a, b) that has a smaller b, with its least one."""
    return pairs.groupBy("a").agg(F.min("b").alias("low")).where("low < a")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its least node."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(),
                    "component-links")
    while True:
        # Large star: each larger neighbour of a node links to the node's least neighbour (or the node).
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "component-low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        # Small star: each smaller neighbour of a node, and the node, link to its least neighbour.
        large = written(large.distinct(), "component-large")
        low = written(_relink(large), "component-low")
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")) \
            .select("e.a", "e.b").where("a > b").distinct()
        after = written(small, "component-links")
        # Done when every node has one link, to a node that has none itself.
        many = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        deep = many or after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        edges = after
        if not many and not deep:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
