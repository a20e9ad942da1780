"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.llm.common import materialize, release


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of every node on the least of them and itself: the larger neighbours only
    (large star), or the smaller ones and the node (small star)."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    hung = near.join(least, "u")
    if small:
        return hung.where("v <> m").select("m", F.col("v").alias("w")).union(least.select("m", F.col("u").alias("w"))).where("m <> w")
    return hung.where("v > u").select("m", F.col("v").alias("w")).where("m <> w")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; component is the least node reachable. Nulls are ignored.

    Each round writes its edges to the shared folder, so no round depends on another's executors.
    The rounds end when a round changes nothing; their number grows with the logarithm of the size.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components")
    state = None
    while True:
        new, old = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first(), state
        if new == old or new[0] == 0:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
        state = new
        large = _star(edges, small=False).toDF("a", "b").distinct()
        done, edges = edges, materialize(_star(large, small=True).toDF("a", "b").distinct(), "components")
        release(done)
