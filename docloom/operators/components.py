"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.shared import cut


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``id, group_id`` for every node of the edges ``a, b``; group_id is the smallest id of the component.

    Both star steps only link a node to the smallest neighbour, so a round writes at most as many edges as it reads and
    no component is ever gathered. Self-loops and edges with a null end are ignored; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a != b")
    now = cut(pairs.distinct(), "edges")
    before: tuple | None = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("low").alias("b")).unionByName(
            joined.filter("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        ).filter("a != b").distinct()
        now = cut(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("group_id")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("group_id")).distinct()
    )
