"""Connected components of an edge table, by alternating star contraction; nothing is gathered on the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Edges that one task takes in a round; fewer edges make fewer tasks.
EDGES = 1 << 16


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Rows (node, component): every node of an edge with the smallest node it reaches.

    edges: two non-null long columns, in any direction, repeated or looped; an empty table gives no rows.
    Each round links every neighbour of a node to the smallest one, first upwards, then downwards; the
    number of rounds grows with the logarithm of the nodes. A hub's rows are met by a join, whose large
    partitions Spark splits, after a minimum that is combined before the shuffle. A round reads its edges in as many
    tasks as they need, EDGES each, so that few edges don't make many empty tasks.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    star = cut_lineage(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _print_of(star)
    while seen[0]:
        tasks = math.ceil(seen[0] / EDGES)
        sym = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(2 * tasks if tasks > 1 else 1)
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = down.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).coalesce(2 * tasks if tasks > 1 else 1)
        star = cut_lineage(down.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        now = _print_of(star)
        if now == seen:
            break
        seen = now
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
