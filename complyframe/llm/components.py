"""Connected components on built-in functions: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complyframe.llm.shared import stored

MOST_ROUNDS = 60


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``edges`` (a, b) with a > b, each once.

    Large: every node's larger neighbours are tied to the smallest of its
    neighbours and itself. Small: the node and its smaller neighbours are.
    The minimum is combined in the map tasks; in the join it is the side with
    one row per node, so Spark can split the rows of a hub.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = seen.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(low.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """``node`` and ``component`` (the smallest node of its component) for every node with an edge to another.

    Edges with a null end and loops are left out; repeats and directions do not
    matter; without edges the result is empty. Every step is written to the
    shared folder, and no more than a count and a checksum reaches the driver.
    """
    held = edges.select(F.greatest(source, target).alias("a"), F.least(source, target).alias("b"))
    held = held.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col("a") > F.col("b")))
    held = stored(held.distinct(), "edges")
    before = _fingerprint(held)
    for _ in range(MOST_ROUNDS if before[0] else 0):
        held = stored(_star(stored(_star(held, True), "large"), False), "small")
        now = _fingerprint(held)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
