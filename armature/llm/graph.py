"""Connected components by alternating stars (Kiveris et al., 2014).

An edge list shrinks to stars: the large star links every greater neighbour of
a node to the node's least neighbour, the small star every smaller one.  Minima
are map-side aggregates and the joins back are shuffle joins whose hot keys
adaptive execution splits, so a component of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armature.llm.common import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, folder: str, label: str) -> DataFrame:
    """(u, v): every node that has an edge, except the least of its component, with that least node."""
    spark = edges.sparkSession
    now = stage(edges.where("u <> v").select("u", "v").distinct(), folder, f"{label}-0")
    mark, step = None, 0
    while True:
        step += 1
        now = stage(_small_star(_large_star(now)), folder, f"{label}-{step}")
        discard(spark, folder, f"{label}-{step - 1}")
        # a converged list is a set of stars, which a further round leaves as it is
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now
        mark = tuple(seen)
