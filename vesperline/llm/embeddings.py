"""Embedding near-duplicates: a pigeonhole over low-dimensional blocks of rotated vectors, verified exactly."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperline.llm._components import connected_components
from vesperline.llm._spark import as_table

_TILE = 1024
_SIEVE = 1e-5


def _vectors(rows: DataFrame) -> DataFrame:
    """(_id, key, size, vec): vectors, scaled to a greatest component from 0.5 to 1, as bytes of doubles with a digest of
    them; key is null where there is no direction."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.array([n or 0 for n in pc.list_value_length(lists).to_pylist()], np.int64)
            flat = pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # nulls: NaN; -0: 0
            ends = np.cumsum(sizes)
            keys, vecs = [], []
            for start, end in zip((ends - sizes).tolist(), ends.tolist()):
                v = flat[start:end]
                top = np.abs(v).max() if end > start and np.isfinite(v).all() else 0.0
                if not top:
                    keys.append(None)
                    vecs.append(None)
                    continue
                v = np.ldexp(v, -np.frexp(top)[1])  # by a power of two: no cosine changes, and no square overflows
                vecs.append(v.tobytes())
                keys.append(hashlib.blake2b(vecs[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(vecs, pa.binary())], ["_id", "key", "size", "vec"])

    return rows.mapInArrow(run, "_id long, key binary, size long, vec binary")


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _second_moments(classes: DataFrame, size: int) -> np.ndarray:
    """The summed outer products of all unit vectors: by task, then in 64 groups, and those on the driver."""

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            x = _unit(_matrix(batch.column(0), size))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"m": pa.array([sum(np.frombuffer(b, np.float64) for b in table["m"].to_pylist()).tobytes()], pa.binary())})

    parts = classes.select("vec").mapInArrow(run, "m binary").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64)))
    sums = parts.groupBy("g").applyInArrow(add, "m binary").collect()
    return sum((np.frombuffer(r.m, np.float64) for r in sums), np.zeros(size * size)).reshape(size, size)


@dataclass(frozen=True)
class Blocks:
    """Rotated axes dealt to blocks, and each block's share of the squared distance."""

    rotation: np.ndarray  # columns in block order
    starts: np.ndarray
    budgets: np.ndarray

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distance in each block for pairs of unit vectors."""
        return np.add.reduceat(((a - b) @ self.rotation) ** 2, self.starts, axis=1)


def plan_blocks(moments: np.ndarray, squared: float, width: int) -> Blocks:
    """Principal axes, dealt out and back so that blocks have like spread; the budget goes by spread.

    If a pair's squared distance is within ``squared``, some block's is within its share, whatever the shares are.
    """
    values, axes = np.linalg.eigh(moments)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    n = max(1, len(values) // width)
    turn = [i if (k // n) % 2 == 0 else n - 1 - i for k, i in ((k, k % n) for k in range(len(values)))]
    order = np.argsort(turn, kind="stable")
    sizes = np.bincount(turn, minlength=n)
    starts = np.cumsum(sizes) - sizes
    spread = np.add.reduceat(values[order], starts) + 1e-12 * max(values.sum(), 1)
    return Blocks(np.ascontiguousarray(axes[:, order]), starts, squared * spread / spread.sum() + 1e-12)


def _slabs(batch: pa.RecordBatch, size: int, blocks: Blocks, radius: np.ndarray) -> np.ndarray:
    """Each vector's slab in each block, by the block's first axis; slabs are as wide as the block's radius."""
    return np.floor(_unit(_matrix(batch.column(1), size)) @ blocks.rotation[:, blocks.starts] / radius).astype(np.int64)


def _dealt(classes: DataFrame, size: int, blocks: Blocks, rows_a_chunk: int) -> DataFrame:
    """Each vector to the slabs of each block: its own and, as a visitor, the one below, so that a pair within the
    radius meets in one slab or in neighbours. Slabs are cut into chunks of ``rows_a_chunk``, own rows and visitors
    alike; each pair of chunks is a task of its own and is compared once."""
    radius = np.sqrt(blocks.budgets) * (1 + 1e-6)

    def count(batches):
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            slab = _slabs(batch, size, blocks, radius)
            for b in range(len(radius)):
                for s, n in zip(*(x.tolist() for x in np.unique(slab[:, b], return_counts=True))):
                    found[b, s] = found.get((b, s), 0) + n
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.int64())], ["block", "slab", "n"])

    # a unit vector's coordinate is in [-1, 1], so slabs are few whatever the input
    sums = classes.select("node", "vec").mapInArrow(count, "block long, slab long, n long").groupBy("block", "slab").agg(F.sum("n").alias("n"))
    chunks = {(r.block, r.slab): -(-r.n // rows_a_chunk) for r in sums.collect()}

    def run(batches):
        for batch in batches:
            slab = _slabs(batch, size, blocks, radius)
            node = batch.column(0).to_numpy()
            mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            rows = {k: [] for k in ("block", "slab", "i", "j", "role", "at")}

            def send(*values):
                for k, v in zip(rows, values):
                    rows[k].append(np.broadcast_to(np.asarray(v, np.int64), values[-1].shape))

            for b in range(len(radius)):
                for s in np.unique(slab[:, b]).tolist():
                    at = np.flatnonzero(slab[:, b] == s)
                    n, above, below = (chunks.get((b, s + d), 0) for d in (0, 1, -1))
                    mine = mixed[at] % n
                    for i in np.unique(mine).tolist():
                        some = at[mine == i]
                        send(b, s, i, i, 0, some)
                        for j in range(n):
                            if j != i:  # a pair of own chunks, under the lesser number
                                send(b, s, min(i, j), max(i, j), 1 if i < j else 3, some)
                        for j in range(above):
                            if j != i:
                                send(b, s, i, n + j, 1, some)
                        for j in range(below):
                            if j == i:
                                send(b, s - 1, i, i, 2, some)
                            else:
                                send(b, s - 1, j, below + i, 3, some)
            flat = {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in rows.items()}
            at = flat.pop("at")
            for lo in range(0, len(at), 1 << 15):
                cut = slice(lo, lo + (1 << 15))
                columns = [pa.array(v[cut]) for v in flat.values()] + [c.take(pa.array(at[cut])) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(columns, [*flat, "node", "vec", "copies"])

    return classes.select("node", "vec", "copies").mapInArrow(run, "block long, slab long, i long, j long, role long, node long, vec binary, copies long")


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _join_slab(size: int, blocks: Blocks, least: float):
    """The links of one slab (or of a pair of its chunks) that its block is the first to find."""

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        role, node, copies = (table[k].to_numpy() for k in ("role", "node", "copies"))
        x = _matrix(table["vec"], size)
        unit = _unit(x)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        lo = blocks.starts[block]
        hi = blocks.starts[block + 1] if block + 1 < len(blocks.starts) else size
        y = unit @ blocks.rotation[:, lo:hi]
        budget = blocks.budgets[block]
        radius = np.sqrt(budget) * (1 + 1e-6)
        half = np.einsum("ij,ij->i", y, y)
        one = np.ones(len(y))
        # one product of these gives squared distances; single precision only sieves, with room for its rounding
        sides = [np.column_stack(c).astype(np.float32) for c in ((-2 * y, half, one), (y, one, half))]
        order = np.argsort(y[:, 0], kind="stable")
        found_a, found_b = [], []

        def verify(p: np.ndarray, q: np.ndarray) -> None:
            cosine = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q])
            s, t = p[cosine >= least], q[cosine >= least]
            if len(s):
                s, t = np.where(node[s] < node[t], s, t), np.where(node[s] < node[t], t, s)
                owner = np.argmax(blocks.distances(unit[s], unit[t]) <= blocks.budgets, axis=1)
                found_a.append(s[owner == block])
                found_b.append(t[owner == block])

        def compare(left: np.ndarray, right: np.ndarray, same: bool) -> None:
            """``same``: both sides are one list."""
            for i in range(0, len(left), _TILE):
                a = left[i : i + _TILE]
                first = i if same else np.searchsorted(y[right, 0], y[a[0], 0] - radius)
                last = np.searchsorted(y[right, 0], y[a[-1], 0] + radius, side="right")
                for j in range(first, last, _TILE):
                    b = right[j : min(j + _TILE, last)]
                    p, q = np.nonzero(sides[0][a] @ sides[1][b].T <= np.float32(budget + _SIEVE))
                    if same and i == j:
                        p, q = p[p < q], q[p < q]
                    p, q = a[p], b[q]
                    for at in range(0, len(p), 1 << 17):
                        verify(p[at : at + (1 << 17)], q[at : at + (1 << 17)])

        by_role = {r: order[role[order] == r] for r in range(4)}
        compare(by_role[0], by_role[0], True)
        compare(by_role[1], by_role[3], False)
        compare(by_role[0], by_role[2], False)
        a, b = (np.concatenate(f) if f else np.empty(0, np.int64) for f in (found_a, found_b))
        names, number = np.unique(node, return_inverse=True)
        a_n, b_n = number[a], number[b]
        links = np.bincount(a_n, copies[b], len(names)) + np.bincount(b_n, copies[a], len(names))
        root = _local_roots(len(names), a_n, b_n)
        some = links > 0
        return pa.table({"node": pa.array(names[some], pa.int64()), "links": pa.array(links[some].astype(np.int64)), "root": pa.array(names[root[some]], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_width: int = 16, rows_a_chunk: int = 32_768) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row: vectors with a cosine of ``least`` (over 0) or more, in
    double precision, are linked.

    Equal vectors are one class and are never expanded into pairs; each counts the others. Vectors that are null,
    empty, zero or hold null or non-finite components, and vectors of different sizes, are not linked. Rows that
    repeat an id count one by one. An empty table gives no rows; other columns are not read.
    """
    if not 0 < least <= 1:
        raise ValueError("least is a cosine over 0")
    rows = as_table(_vectors(vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_vec"))))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("_id").alias("least"), F.count("*").alias("copies"), F.min("size").alias("size"), F.first("vec").alias("vec"))
    # a class has a number of its own: rows that repeat an id may hold different vectors
    classes = as_table(classes.where("least is not null").withColumn("node", F.monotonically_increasing_id()))
    found = None
    for size in sorted(r.size for r in classes.select("size").distinct().collect()):
        some = classes.where(F.col("size") == size)
        blocks = plan_blocks(_second_moments(some, size), 2 - 2 * least, block_width)
        dealt = _dealt(some, size, blocks, rows_a_chunk)
        part = dealt.groupBy("block", "slab", "i", "j").applyInArrow(_join_slab(size, blocks, least), "node long, links long, root long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node long, links long, root long")
    found = as_table(found)
    parts = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = parts.join(classes.select("node", "least"), "node")
    parts = parts.join(parts.groupBy("component").agg(F.min("least").alias("low")), "component").select("node", "low")
    named = classes.select("key", "node", "least", "copies").join(links, "node", "left").join(parts, "node", "left")
    named = named.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "least").alias("component_id"))
    alone = rows.where("key is null").select("_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = rows.where("key is not null").select("_id", "key").join(named, "key", "left").select(*alone.columns).unionByName(alone)
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
