"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.store import Tables


def _shape(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b) with a > b that isn't the least of its component.

    Edges stay in written tables. The least neighbours are a table of their own, so that the join
    with the edges reads two plain shuffles, of which Spark splits those of a hub. Each round of
    both stars shortens all paths; the loop ends when a round changes nothing, after about the
    logarithm of the longest path.
    """
    now, before = edges, None
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = tables.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = tables.write(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = tables.write(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = tables.write(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        if now is not edges:
            tables.drop(now)
        tables.drop(least, large, low)
        shape = _shape(small)
        now = small
        if shape == before:
            break
        before = shape
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
