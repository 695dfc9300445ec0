"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours move to its least neighbour; small: its smaller ones and itself do.

    Both aggregate first and join then, so that a hub is summed before the shuffle and its rows can be split.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    near = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*") if large else edges.select(high.alias("u"), low.alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.join(least, "u")
    moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of edges (u, v), except roots themselves; root is the least node reachable.

    Null ends, loops and repeated edges change nothing. No edges give no rows. rows: how many edges there are at most, if that is known.
    """
    edges = cut(edges.where("u <> v").select("u", "v").distinct(), rows)
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        edges = cut(_stars(_stars(edges, True), False), 2 * state[0])
