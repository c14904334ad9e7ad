"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns ``a`` and ``b``); component is the smallest node reachable.

    Every round replaces edges by edges to a neighbourhood's minimum and is written to the shared folder. Aggregates run
    map-side and the join back is an equi-join that adaptive execution may split, so a hub needs no task of its own.
    Raises if the rounds do not converge.
    """
    now = settle(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
        now = settle(small.filter(F.col("a") != F.col("b")).distinct(), "cc")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            root = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
            return root.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
