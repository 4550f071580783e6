"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join, so no component is ever gathered in one task; a star's centre is a
hot key of the join only, whose partitions Spark may split. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _digest(edges: DataFrame) -> tuple:
    """A figure that stays the same once a round changes nothing."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of ``u`` is linked to the least of ``u`` and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """``u`` and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u long, v long): root is the least node of its component.

    Nodes without an edge have no row; loops and repeated edges are allowed.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
                 .distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        now = stored(_small_star(_large_star(now)).distinct(), "edges")
        was, seen = seen, _digest(now)
        if was == seen:
            break
    return (now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
