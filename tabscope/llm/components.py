"""Connected components of a link table, by alternating large and small stars.

Each round hangs nodes under the smallest node they touch; rounds grow with the logarithm of the
number of nodes.  A node with very many links is no problem: minima are pre-aggregated and the
joins are split by the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common as C


def components(links: DataFrame, room: str) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, long): root is the smallest node reached."""
    spark = links.sparkSession
    edges = C.stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{room}/star0")

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first())

    def lowest(df):
        return df.groupBy("u").agg(F.min("v").alias("m"))

    now, turn = state(edges), 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours hang under the least of the node and its neighbours.
        large = (both.join(lowest(both).withColumn("m", F.least("m", "u")), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: the smaller neighbours and the node itself hang under the least neighbour.
        small = large.join(lowest(large), "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        edges = C.stored(small, f"{room}/star{turn}")
        C.discard(spark, f"{room}/star{turn - 1}")
        before, now = now, state(edges)
        if now == before:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
