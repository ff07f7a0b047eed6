"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.sources.shared import durable, tidy

#: Edges of one file while components are worked out; few edges need few files.
EDGES_A_PART = 200_000


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


@tidy
def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b of one type that can be ordered): component is the smallest
    reachable node. Null ends and links of a node with itself are left out.

    Alternating large-star and small-star rounds: each is two grouped minima and a join, hubs only ever
    send one row per neighbour, and each round is written to the shared folder.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        parts = 1 + state[0] // EDGES_A_PART
        now = durable(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(parts))
        last, state = state, _state(now)
        if last == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not state[0]:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
