"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _with_minimum(edges: DataFrame) -> DataFrame:
    """Each directed edge beside the smallest node known around its source.

    A plain aggregate and a join: a hub's edges are combined on the map side, and its join partition
    can be split, where a window would pull the hub into one task.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`component` (lowest node of the piece) for every node(id), given edges(a, b).

    Rounds go on until no edge changes; their number grows with the logarithm of the nodes.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = checkpointed(links)
    mark = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_minimum(large)
        links = checkpointed(
            small.select("u", F.col("m").alias("v")).unionByName(
                small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            ).where("u <> v").distinct()
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    roots = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
