"""Connected components by alternating large-star and small-star rounds, all in tables.

After Kiveris and others, "Connected Components in MapReduce and Beyond" (2014). Every round is written to the shared
folder; the neighbours' minima are a table of their own, so a node with very many links can be split over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesela.llm.common import drop_table, materialize, small


def stars(edges: DataFrame) -> DataFrame:
    """Undirected links `a`, `b` -> `node`, `comp`: the smallest node of the component, for every other node of it.

    It ends when all links are stars: a node has larger neighbours alone, or one neighbour, which is smaller."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = materialize(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low"), F.max("v").alias("high")), "large-star")
        if not near.filter("low < w and low < high").limit(1).count():
            drop_table(near)
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        least = near.select("w", F.least("w", "low").alias("m"))
        # a link gives one at most, so those found twice may stay until the round ends
        large = materialize(both.filter("v > u").join(small(least), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")), "large-links")
        least = materialize(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "small-star")
        pairs = large.join(small(least), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
        new = materialize(pairs.distinct(), "links")
        for done in (now, near, large, least):
            drop_table(done)
        now = new


def components(edges: DataFrame) -> DataFrame:
    """Undirected links `a`, `b` -> `node`, `comp`: the smallest node of the component, for every node with a link."""
    found = stars(edges)
    return found.unionAll(found.select(F.col("comp").alias("node"), "comp").distinct())
