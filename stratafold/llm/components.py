"""Connected components by alternating large and small stars, in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import staged


def _to_least(edges: DataFrame) -> DataFrame:
    """a, b, least: the smallest b of each a joined to all its edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    return edges.join(least, "a")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for every node of the edges (a, b); a component is its smallest node.

    Every round is written to the shared folder, and only counts come to the driver.
    """
    now = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "components",
    )
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            _to_least(both)
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        star = _to_least(large)
        small = star.select("a", F.col("least").alias("b")).unionByName(
            star.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        )
        now = staged(small.distinct(), "components")
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    nodes = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
