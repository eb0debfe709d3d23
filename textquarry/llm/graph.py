"""Connected components by alternating star contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import remove, saved, skewed_left_join


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any comparable type -> (node, component), component being the smallest node reached.

    Each round hangs every node's larger neighbours, then its smaller ones, on its smallest neighbour; hubs
    therefore shed their neighbours and no node keeps a long list. Minima are partial aggregates, one row a node, and the few hubs
    that hold a thousandth of all edges get theirs by a broadcast, so no task takes a hub's edges. Each half
    round's edges are written to the shared folder; those before are then deleted. Nodes without an edge are absent; an empty input
    gives an empty result.
    """
    spark = edges.sparkSession
    now, path = saved(edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _sum(now)
    while before[0]:
        # large star: every larger neighbour (and the node itself) to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = skewed_left_join(both, least, "u", "n", 2 * before[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour and the node to the smallest neighbour
        small, small_path = saved(large.filter("u > v").distinct(), "edges")
        least = small.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        new = skewed_left_join(small, least, "u", "n", before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        new, new_path = saved(new, "edges")
        remove(spark, path)
        remove(spark, small_path)
        now, path, after = new, new_path, _sum(new)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return row[0], int(row[1])
