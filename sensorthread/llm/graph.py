"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorthread.session import written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


def connected_components(links: DataFrame) -> DataFrame:
    """From links (a, b) of whole numbers, (node, root) for every linked node: root is the least node it reaches.

    Every round hangs each node's neighbours below its least neighbour, first the greater ones and then the smaller
    ones. Rounds grow with the logarithm of the longest path. Each is a table in the shared folder. A node with many
    neighbours is one row of a map-side combined minimum, and its join is split by adaptive execution.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    before = _signature(edges)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(lower.select("u", F.col("m").alias("v")).unionAll(moved).distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )
