"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskframe.llm.frames import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the least in its neighbourhood."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """Each linked node with the least node of its component: columns node, root.

    `links` has columns a and b of one ordered type; direction, repeats, loops
    and nulls do not matter.  Every round is written to the shared scratch folder;
    the rounds needed grow with the logarithm of the longest path.  Minima are
    combined before each shuffle, so a node with very many links is no hot group,
    and the joins can be split where a star is large.
    """
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        links = written(_small_star(_large_star(links).distinct()).distinct(), "links")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
