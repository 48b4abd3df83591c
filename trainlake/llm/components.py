"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, stored


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star pass; edges are (a, b) with a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.filter("a != b").distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    pulled = large.join(lowest, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = lowest.select("a", F.col("m").alias("b"))
    return pulled.unionByName(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    ``links`` has two long columns ``a`` and ``b``; order, repeats and
    self-links don't matter.  Each round is a few grouped minima and joins on
    the node; its edges are written to the shared folder, so rounds don't nest.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(links.select(a.alias("a"), b.alias("b")).filter("a != b").distinct(), "links")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("mark")
    before = edges.agg(F.count("*").alias("n"), mark).first()
    while before["n"]:
        last, edges = edges, stored(_step(edges), "links")
        forget(last)
        after = edges.agg(F.count("*").alias("n"), mark).first()
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
