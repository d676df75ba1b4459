"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelflow.operators.sized import written


LINKS_PER_FILE = 200_000


def _nearest(links: DataFrame) -> DataFrame:
    """a, b, low: each link with the smallest of a and its neighbours; a hot a is folded in the map tasks, then joined back."""
    low = links.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    return links.join(low, "a")


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _nearest(both).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    found = _nearest(down)
    hung = found.select(F.col("b").alias("a"), F.col("low").alias("b")).union(found.select("a", F.col("low").alias("b")))
    return hung.filter("a <> b").distinct()


def _unsettled(links: DataFrame) -> int:
    """Nodes that hang on several others, or hang on one and are hung on: none is left when all links are stars."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.agg(F.count_if(F.col("up") + F.col("down") > 1)).first()[0]


def components(links: DataFrame) -> DataFrame:
    """node, label of every node of ``links`` (columns a, b); label is the smallest node reachable.

    Each round's links are written, in as many files as their number asks for, so a lost executor costs a round at
    most.  Rounds grow with the logarithm of the longest chain.  A null end makes a link void.
    """
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while _unsettled(links):
        files = max(1, links.count() // LINKS_PER_FILE)
        links = written(_small(_large(links)).coalesce(files))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(links.select("b", "b").distinct())
