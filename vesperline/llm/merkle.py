"""Merkle manifest of a table: a tree for each source, a tree over the sources, and every row's proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperline.llm._spark import as_table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_STEP = "struct<left:string,right:string>"
_SMALL = 8 << 20  # bytes of a table that every task may get


def digest(content: Column) -> Column:
    return F.sha2(F.encode(content, "UTF-8"), 256)


def leaf_of(*values: Column) -> Column:
    """The hash of a row's values: each ``-`` if null, else its UTF-8 length, a colon and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return digest(F.concat(*parts))


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` marked to be sent to all tasks where its rows prove few; beyond that it is shuffled like any table."""
    return F.broadcast(df) if df.count() * row_bytes <= _SMALL else df


def indexed(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``gid`` (the group's number in order, null first), ``idx`` (the place in it) and ``n`` (its size);
    and ``(group, gid, n)``. Both count from 0.

    Rows are dealt by ranges of (group, order) and counted in runs, one for each partition and group, so a group of any
    size is spread over many tasks. Groups are numbered in the same way.
    """
    by = [group, *order]
    placed = lambda df, by: as_table(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = lambda w: F.coalesce(F.sum("_size").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = [F.min("_at").alias("_first"), F.count("*").alias("_size")]
    table = placed(rows, by)
    runs = as_table(table.groupBy("_part", group).agg(*run))
    numbered = placed(runs.groupBy(group).agg(F.sum("_size").alias("n")), [group])
    blocks = numbered.groupBy("_part").agg(*run).select("_part", (F.col("_first") - before(Window)).alias("_shift"))  # a row for each partition
    groups = as_table(numbered.join(F.broadcast(blocks), "_part").select(group, (F.col("_at") - F.col("_shift")).alias("gid"), "n"))
    starts = runs.select("_part", group, (F.col("_first") - before(Window.partitionBy(group))).alias("_shift"))
    runs = as_table(starts.alias("r").join(groups.alias("g"), F.col(f"r.{group}").eqNullSafe(F.col(f"g.{group}"))).select("r.*", "g.gid", "g.n"))
    same = (F.col("t._part") == F.col("r._part")) & F.col(f"t.{group}").eqNullSafe(F.col(f"r.{group}"))
    out = table.alias("t").join(_small(runs, 128).alias("r"), same)
    return out.select(*[F.col(f"t.{c}") for c in rows.columns], "r.gid", (F.col("_at") - F.col("r._shift")).alias("idx"), "r.n"), groups


def grow(leaves: DataFrame, arity: int = 3) -> tuple[list[DataFrame], DataFrame]:
    """``leaves(gid, n, idx, hash)`` -> the levels ``(gid, n, idx, left, right, hash)`` and the roots ``(gid, hash)``.

    Each level equijoins its nodes with their siblings at computed indices: the other slots of the run, by their offset
    from the node's own. The rows in slot zero then emit the parents. A group leaves when one node of it remains.
    """
    levels, roots = [], leaves.where("n = 1").select("gid", "hash")
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves
    while most > 1:
        nodes = nodes.where("n > 1").select("gid", "n", "idx", "hash")
        slot = F.col("idx") % arity
        out = nodes.select("*", *[(F.col("idx") - slot + (slot + k) % arity).alias(f"_to{k}") for k in range(1, arity)])
        for k in range(1, arity):
            other = nodes.select(F.col("gid").alias("_gid"), F.col("idx").alias("_idx"), F.col("hash").alias(f"_h{k}"))
            out = out.join(other.hint("merge"), (F.col("gid") == F.col("_gid")) & (F.col(f"_to{k}") == F.col("_idx")), "left").drop("_gid", "_idx")
        # the sibling k slots on stands right of a node, or left of it where that wraps round
        h = lambda k: F.coalesce(F.col(f"_h{k}"), F.lit(""))
        right = F.concat(*[F.when(slot + k < arity, h(k)).otherwise("") for k in range(1, arity)])
        left = F.concat(*[F.when(slot + k >= arity, h(k)).otherwise("") for k in range(1, arity)])
        levels.append(as_table(out.select("gid", "n", "idx", left.alias("left"), right.alias("right"), "hash")))
        parents = levels[-1].where(F.col("idx") % arity == 0)
        nodes = parents.select("gid", F.ceil(F.col("n") / arity).cast("long").alias("n"), F.expr(f"idx div {arity}").alias("idx"), digest(F.concat("hash", "right")).alias("hash"))
        roots = roots.unionByName(nodes.where("n = 1").select("gid", "hash"))
        most = -(-most // arity)
    return levels, roots


def paths(levels: list[DataFrame], roots: DataFrame, arity: int = 3) -> DataFrame:
    """``(gid, idx, path, ...)`` of every leaf: its siblings level by level, behind them the path of its group's root.

    ``roots(gid, n, path, ...)`` are single nodes; what else they hold goes down with the path. From the top each node
    takes its parent's path, so the work is that of the levels and not of all leaves at every level. Each level's paths
    but the leaves' are written, and levels are merged, not broadcast: the driver holds neither rows nor a plan of all levels.
    """
    carried = [c for c in roots.columns if c not in ("gid", "n", "path")]
    ends = roots.withColumn("_levels", _levels_of(F.col("n"), arity))
    above = None
    for level in reversed(range(len(levels))):
        single = ends.where(F.col("_levels") == level + 1).select("gid", F.lit(0).cast("long").alias("_up"), "path", *carried)
        above = single if above is None else as_table(above).withColumnRenamed("idx", "_up").unionByName(single)
        own = levels[level].select("gid", "idx", F.expr(f"idx div {arity}").alias("_up"), F.array(F.struct("left", "right")).alias("_own"))
        above = own.join(above.hint("merge"), ["gid", "_up"]).select("gid", "idx", F.concat("_own", "path").alias("path"), *carried)
    alone = ends.where("n = 1").select("gid", F.lit(0).cast("long").alias("idx"), "path", *carried)
    return alone if above is None else above.unionByName(alone)


def _levels_of(n: Column, arity: int) -> Column:
    """How often a run of ``arity`` nodes becomes one until one is left, by whole numbers."""
    out, power = F.lit(0), 1
    while power < 1 << 62:
        out, power = out + (n > power).cast("int"), power * arity
    return out


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda h, step: digest(F.concat(step["left"], h, step["right"])))


def manifest(rows: DataFrame, claimed: Column | None = None, fields: list[str] | None = None, group: str = "source", id_col: str = "doc_id", arity: int = 3) -> DataFrame:
    """``(id, leaf, subroot, root, path, folded_root, verified)`` for every row of a table.

    ``leaf`` hashes the ``fields`` (the last one is the content); rows of a group ascend by id, nulls first, and
    equal ids by their leaf, so repeated rows stand beside each other. ``path`` has the siblings of each level to the root. Where ``claimed`` is given
    it is a content to verify in place of the last field: ``folded_root`` follows from it and the row's path alone.
    An empty table gives no rows, and a single row's leaf is its own root. Other columns are not read.
    """
    fields = fields or FIELDS
    values = [F.col(f) for f in fields]
    claim = leaf_of(*values[:-1], values[-1] if claimed is None else claimed)
    leaves = as_table(rows.select(F.col(id_col).alias("_id"), F.col(group).alias("_group"), leaf_of(*values).alias("_leaf"), claim.alias("_claim")))
    leaves, groups = indexed(leaves, "_group", ["_id", "_leaf"])
    leaves = as_table(leaves)
    levels, subroots = grow(leaves.select("gid", "n", "idx", F.col("_leaf").alias("hash")), arity)
    sizes = groups.select("gid", F.col("n"))
    subroots = as_table(subroots.join(sizes.hint("merge"), "gid").select("gid", "n", "hash"))
    n_groups = groups.count()
    top = subroots.select(F.lit(0).cast("long").alias("gid"), F.lit(n_groups).cast("long").alias("n"), F.col("gid").alias("idx"), "hash")
    top_levels, root = grow(top, arity)
    found = root.first()  # one digest
    base = root.select("gid", F.lit(n_groups).cast("long").alias("n"), F.array().cast(f"array<{_STEP}>").alias("path"))
    above = paths(top_levels, base, arity).select(F.col("idx").alias("gid"), "path")
    ends = as_table(above.join(subroots.hint("merge"), "gid").select("gid", "n", "path", F.col("hash").alias("subroot")))
    out = leaves.join(paths(levels, ends, arity).hint("merge"), ["gid", "idx"]).withColumn("root", F.lit(found.hash if found else None).cast("string"))
    out = out.withColumn("folded_root", folded(F.col("_claim"), F.col("path")))
    return out.select(F.col("_id").alias(id_col), F.col("_leaf").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))
