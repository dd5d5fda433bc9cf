"""Connected components of a table of links, without driver-side state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def _least(links: DataFrame) -> DataFrame:
    """(u, m): the least of each node and its neighbours in (u, v)."""
    return links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b; longs): label is the least node it can reach.

    Large-star and small-star in turn: each step joins every node with the least of its
    neighbourhood, which map-side combining makes cheap for hubs; stars of any size stay rows
    of a join that can be split, never one group.  Each round is a written table.
    """
    spark = links.sparkSession
    now, path = storage.written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:  # the rounds grow with the logarithm of the longest path
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = large.join(_least(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        after, new_path = storage.written(small.filter("u <> v").distinct(), "links")
        storage.drop(spark, path)
        path, now = new_path, after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
        mark = seen
