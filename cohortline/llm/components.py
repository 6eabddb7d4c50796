"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import durable


def _both_ways(links: DataFrame) -> DataFrame:
    return links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    sides = _both_ways(links)
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return sides.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node of a link between different nodes; a component is its least node.

    Links may repeat and point either way; nulls and loops are left out. Each round is written to the shared folder, so
    a lost executor repeats one round. Rounds grow with the logarithm of a component's size. Minima are summed map-side
    and joined back, so that a node with very many links is never gathered in one task.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return durable(df.filter("a <> b").distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = tidy(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
    seen = mark(now)
    while seen[0]:
        now = tidy(_small_star(_large_star(now)))
        if (then := mark(now)) == seen:
            break
        seen = then
    # at rest every node hangs on its component's least node
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
