"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, stored


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs(u, v), u != v. Large star: each node hangs its larger neighbours under its least one; small star: the node and its smaller ones."""
    if large:
        near = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:
        out = near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _is_forest(pairs: DataFrame) -> bool:
    """Whether pairs(u, v) are stars: each u has one v, and no v is a u."""
    if pairs.groupBy("u").count().filter("count > 1").limit(1).count():
        return False
    return not pairs.join(pairs.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node that each node of an edge can reach. Nodes without edges, null ends and loops give no row.

    Each round is written to the shared folder; the driver only learns whether the pairs are stars yet.
    """
    pairs = stored(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "cc")
    while not _is_forest(pairs):
        after = stored(_star(_star(pairs, True), False), "cc")
        discard(pairs)
        pairs = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
