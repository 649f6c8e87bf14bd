"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelway.session import stage_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours of each node are hung on the least node around it.

    ``large`` moves the greater neighbours only, otherwise the lesser ones move
    together with the node. The least neighbour is a map-side combined minimum,
    so no node's neighbours are ever gathered.
    """
    if large:
        around = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select("v", "m").unionAll(least.select(F.col("u").alias("v"), "m"))
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots themselves; the root is the least node.

    Each round is written to the shared folder, so lost executors cost one round.
    """
    edges = stage_table(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(),
        "edges",
    )
    seen = None
    while True:
        found = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if found == seen or not found[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = found
        edges = stage_table(_stars(_stars(edges, True), False), "edges")
