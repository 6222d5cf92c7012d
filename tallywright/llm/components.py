"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.shared import stored


def _to_smallest(pairs: DataFrame, keep_root: bool) -> DataFrame:
    """Every neighbour of a node linked to the smallest of the node and its neighbours.

    ``pairs`` (u, v) holds what counts as u's neighbours v. The minimum is aggregated before the
    shuffle; the join back is one that Spark splits for a hub. Joins are by merge: a broadcast of every step's
    small table, and there are many steps, goes through the driver's memory.
    """
    smallest = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = pairs.join(smallest.hint("merge"), "u").where(F.col("v") != F.col("m")).select("v", "m")
    if keep_root:
        moved = moved.union(smallest.where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), "m"))
    return moved.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(id, component_id) of every node of ``links`` (a, b), a component's id being its smallest node.

    Each step is written to the shared folder; steps end when the links no longer change. The number
    of steps grows with the logarithm of the number of nodes.
    """
    spark = links.sparkSession
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # Large star: only larger neighbours move to the smallest one.
        smallest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(smallest.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours move to the smallest of them.
        edges = stored(_to_smallest(large, keep_root=True), name)
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots) if before[0] else spark.createDataFrame([], "id long, component_id long")
