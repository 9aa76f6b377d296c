"""Connected components as joins, by alternating large and small stars.

In a large-star step every node points its larger neighbours at the smallest node it knows; in a small-star step every node
points its smaller neighbours, and itself, at the smallest of them. Both keep the components; repeated, they leave a star
around the smallest node of each, after a number of rounds that grows with the logarithm of the size. Minima are combined
in each task before they shuffle. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymatch.plans.staging import Stage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = both.filter("b > a").join(least, "a")
    return met.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    met = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return met.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """id, component (the smallest id in it) for every node of the edges (a, b) of longs."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stage.save(edges, "edges")
    before, now = None, _mark(edges)
    while now != before:
        edges = stage.save(_small(_large(edges)), "edges")
        before, now = now, _mark(edges)
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
