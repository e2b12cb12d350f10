"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a grouped minimum (partly summed before it is shuffled) and an equi-join whose skewed keys Spark can split;
its result is written to the shared folder, so nothing depends on one executor and nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, staged


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b. Large: each a links its larger neighbours to its least; small: its smaller ones and itself."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        new = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = near.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return new.where("a > b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long) in either order, without nulls. Returns (node, root) of every node with a link to another;
    root is the least node that it reaches. An empty table gives an empty one."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    links, path = staged(links, "links")
    mark = _mark(links)
    while True:
        half, between = staged(_stars(links, large=True), "links")
        whole, after = staged(_stars(half, large=False), "links")
        for old in (path, between):
            discard(links.sparkSession, old)
        links, path, was = whole, after, mark
        mark = _mark(links)
        if mark == was:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
