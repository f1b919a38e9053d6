"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.tables import keep


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (least node of its component) for every node of ``edges`` (a, b).

    Each step replaces edges by edges to the least neighbour; the number of edges
    does not grow and stars remain after a number of rounds that is logarithmic
    in practice.
    """
    links = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    links = keep(links)
    seen = None
    while True:
        both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v: node, u: neighbour
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        links = keep(small.union(least.select("v", F.col("m").alias("u"))).distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return links.select(F.col("v").alias("node"), F.col("u").alias("root")).union(links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
