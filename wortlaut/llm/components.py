"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wortlaut.llm.shared import checkpointed


def _stars(links: DataFrame, node: str, other: str) -> DataFrame:
    """Each link with the smallest node that its ``node`` touches, itself included."""
    least = links.groupBy(node).agg(F.min(other).alias("_least"))
    return links.join(least.withColumn("_least", F.least("_least", node)), node)


def connected(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """The smallest reachable node of every node that has a link: ``node``, ``root``.

    Every round links each node's larger neighbours to the smallest node around it, then its smaller ones; that keeps
    the components and ends, after a number of rounds that grows with the logarithm of a component's size, in stars
    around the roots.  Each round is kept in the shared folder.  Links with a null end, and from a node to itself, say
    nothing and are ignored; without links the result is empty.
    """
    ends = F.col(left), F.col(right)
    edges = links.filter(ends[0] != ends[1]).select(F.greatest(*ends).alias("child"), F.least(*ends).alias("parent"))
    edges = checkpointed(edges.distinct())
    state = None
    for _ in range(rounds):
        found = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("child", "parent"))).first()
        if found == state:
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(
                edges.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct()
            )
        state = found
        both = edges.unionByName(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")))
        large = (
            _stars(both, "child", "parent")
            .filter(F.col("parent") > F.col("child"))
            .select(F.col("parent").alias("child"), F.col("_least").alias("parent"))
            .distinct()
        )
        small = _stars(large, "child", "parent")
        edges = checkpointed(
            small.filter(F.col("parent") > F.col("_least"))
            .select(F.col("parent").alias("child"), F.col("_least").alias("parent"))
            .unionByName(small.select("child", F.col("_least").alias("parent")))
            .distinct()
        )
    raise RuntimeError(f"components did not settle in {rounds} rounds")
