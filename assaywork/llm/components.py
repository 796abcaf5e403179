"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so no group is gathered; steps grow with the logarithm of
the longest path. Every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaywork.llm.common import drop_staged, stage_measured


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of ``links`` (columns a, b: long): root is the least id that it is
    connected with. Loops and repeated links don't matter; ids without a link aren't returned."""
    sign = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    first = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct()
    now, was = stage_measured(first, **sign)
    while was["n"]:
        new, found = stage_measured(_small_star(_large_star(now)), **sign)
        drop_staged(now)
        if found == was:
            now = new
            break
        now, was = new, found
    stars = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())
