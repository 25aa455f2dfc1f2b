"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without an edge have no row.

    Every step groups the edges by a node, takes the smallest neighbour with map-side
    combining and joins it back, so a star with very many points is never in one task
    (adaptive execution splits its join). Steps are cut by reliable checkpoints.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct().checkpoint()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours point to the smallest one
        e = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .filter("u <> v").distinct())
        # small star: smaller neighbours and the node itself point to the smallest one
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("s"))
             .select(F.col("s.v").alias("u"), F.col("s.m").alias("v")).filter("u <> v").distinct().checkpoint())
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
