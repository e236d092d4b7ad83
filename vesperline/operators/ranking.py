"""Ranks in a global order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperline.sources.scratch import as_table

#: What a run takes at most, and what every task may get.
_RUN_BYTES, _BROADCAST = 256, 8 << 20


def ranked(rows: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their rank (from 1) by ``order`` within each group; ``groups`` may be empty.

    Rows are dealt by ranges of (groups, order) and sorted within their partition, so that a group of any size is
    spread; the table of those runs is written once. A run's first rank follows from the sizes of the runs before it,
    which are as few as the partitions and groups.
    """
    by = [*groups, *order]
    return numbered(rows.repartitionByRange(*by).sortWithinPartitions(*by), groups, name)


def numbered(rows: DataFrame, groups: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their rank within each group, for rows that lie in its order: within a partition, and from one
    partition to the next."""
    table = as_table(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    runs = table.groupBy(part, *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    same = F.shiftright("_at", 33) == F.col("r._part")
    for g in groups:
        same = same & F.col(f"t.{g}").eqNullSafe(F.col(f"r.{g}"))
    runs = as_table(runs)
    few = runs.count() * _RUN_BYTES <= _BROADCAST
    out = table.alias("t").join(F.broadcast(runs.alias("r")) if few else runs.alias("r"), same)
    rank = (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name)
    return out.select(*[F.col(f"t.{c}") for c in rows.columns], rank)
