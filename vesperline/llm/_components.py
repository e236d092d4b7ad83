"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperline.llm._spark import as_table


def _with_min(edges: DataFrame) -> DataFrame:
    """(src, dst, m): m is the smallest neighbour of src, src itself included."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    least = least.select("src", F.least("src", "m").alias("m"))
    return edges.join(least, "src")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(src, dst)`` -> ``(node, component)``: the smallest node id reachable from each node.

    Only nodes that have an edge to another node are returned. Minima are combined before the
    shuffle and the rest are plain joins, so a hub with very many neighbours is never gathered
    into one group. Each round is written to the shared scratch folder. Null ids and loops are
    ignored; an empty input gives an empty result.
    """
    flat = edges.where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    now = as_table(flat.distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = (
            _with_min(both).where("dst > src and dst <> m")
            .select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        )
        small = _with_min(large)
        small = (
            small.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            .unionByName(small.select("src", F.col("m").alias("dst"))).distinct()
        )
        now = as_table(small)
        after = _mark(now)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = now.groupBy("src").agg(F.min("dst").alias("component"))
    roots = now.select(F.col("dst").alias("src")).distinct().withColumn("component", F.col("src"))
    return nodes.unionByName(roots).groupBy("src").agg(F.min("component").alias("component")).withColumnRenamed("src", "node")
