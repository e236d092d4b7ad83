"""SimHash near-duplicates: pigeonhole blocks joined, then Hamming distance verified."""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperline.llm._components import connected_components
from vesperline.llm._spark import as_table, shuffle_partitions

BITS = 64
_HASHES_AT_ONCE = 1 << 18


def shingle_hashes(text: str | None, width: int, seed: int) -> list[int]:
    """XXH64 of each run of ``width`` words; of the whole word sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()  # both act on ASCII letters and white space only
    if not words:
        return []
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(line, seed)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1]
    return [digest(line[s:e], seed) for s, e in zip(starts.tolist(), ends[width - 1 :].tolist())]


def majority_bits(hashes: np.ndarray, sizes: list[int], words: int = 1) -> np.ndarray:
    """A fingerprint of ``words`` times 64 bits for each run of ``sizes`` hashes: a bit is set if it is in over half of
    them. Word 0 takes the hashes as they are, later words take them mixed."""
    out = np.zeros((len(sizes), words), np.uint64)
    for w in range(words):
        bits = hashes if not w else (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9 + 2 * w)
        bits = bits if not w else bits ^ bits >> np.uint64(32)
        begin = 0
        for i, n in enumerate(sizes):
            counts = np.zeros(BITS, np.int64)
            for at in range(begin, begin + n, _HASHES_AT_ONCE):
                part = bits[at : min(at + _HASHES_AT_ONCE, begin + n)]
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
            if n:
                out[i, w] = np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]
            begin += n
    return out


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, words: int = 1) -> DataFrame:
    """``(id, fingerprint)`` with the fingerprint as a signed 64-bit number, or with ``words`` over 1 as that many
    times 8 bytes; null or wordless text: 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = np.zeros((len(texts), words), np.uint64)
            hashes: list[int] = []
            sizes: list[int] = []
            begin = 0
            for i, text in enumerate(texts):
                found = shingle_hashes(text, shingle, seed)
                hashes += found
                sizes.append(len(found))
                if len(hashes) >= _HASHES_AT_ONCE or i + 1 == len(texts):
                    prints[begin : i + 1] = majority_bits(np.array(hashes, np.uint64), sizes, words)
                    hashes, sizes, begin = [], [], i + 1
            column = pa.array(prints[:, 0].view(np.int64)) if words == 1 else pa.array([p.tobytes() for p in prints], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), column], ["_id", "_print"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, f"_id long, _print {'long' if words == 1 else 'binary'}").select(F.col("_id").alias(id_col), F.col("_print").alias("fingerprint"))


def block_masks(n_prints: float, distance: int) -> list[int]:
    """Masks of which two prints within ``distance`` bits agree on one at least.

    The 64 bits are cut into ``b`` blocks; ``distance`` flips leave ``b - distance`` blocks whole. ``b``
    is the least that gives a key at least log2(n) bits, so that a key is shared by few unrelated prints.
    """
    b = distance + 1
    while BITS * (b - distance) // b < log2(max(n_prints, 2)) and b < distance + 6:
        b += 1
    cuts = [BITS * i // b for i in range(b + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(blocks, b - distance)]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints of one word, or of rows of words."""
    bits = np.bitwise_count(a ^ b)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


def _group_forest(prints: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[list, list]:
    """A spanning forest of the links inside one bucket: each print is held against those not reached yet."""
    src, dst = [], []
    left = np.arange(len(prints))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = apart(prints[left], prints[at]) <= distance
            if near.any():
                reached = left[near]
                src.append(np.full(len(reached), nodes[at]))
                dst.append(nodes[reached])
                queue.extend(reached.tolist())
                left = left[~near]
    return src, dst


def _by_bucket(read, links):
    """``links(group, prints, nodes)`` over runs of whole buckets of sorted rows (kind, key, print, node)."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []  # parts of the last bucket, which may go on in the next batch
        seen, last = 0, None
        for batch in batches:
            if not len(batch):
                continue
            kind, key, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            new = np.concatenate(([last != (kind[0], key[0])], (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])))
            group = np.cumsum(new) + seen
            rows = (group, read(batch.column(2)), nodes)
            seen, last = int(group[-1]), (kind[-1], key[-1])
            starts = np.flatnonzero(new)
            if not len(starts):
                held.append(rows)
                continue
            closed = [*held, tuple(x[: starts[-1]] for x in rows)]
            held = [tuple(x[starts[-1] :] for x in rows)]
            if sum(len(part[0]) for part in closed):
                yield links(*(np.concatenate(x) for x in zip(*closed)))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def _bucket_links(distance: int, small: int = 24):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def links(group: np.ndarray, prints: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((cut, [len(group)])))
        src, dst = [], []
        rows_size = np.repeat(size, size)
        keep = np.flatnonzero((rows_size > 1) & (rows_size <= small))
        g, p, v = group[keep], prints[keep], nodes[keep]
        for lag in range(1, small):
            same = np.flatnonzero(g[lag:] == g[:-lag]) if len(g) > lag else np.empty(0, int)
            if not len(same):
                break
            near = same[apart(p[same], p[same + lag]) <= distance]
            src.append(v[near])
            dst.append(v[near + lag])
        for i in np.flatnonzero(size > small):
            part = slice(cut[i], cut[i] + size[i])
            a, b = _group_forest(prints[part], nodes[part], distance)
            src += a
            dst += b
        flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, dst)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in flat], schema=schema)

    return _by_bucket(lambda column: column.to_numpy(zero_copy_only=False).view(np.uint64), links)


def hamming_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """``prints(node, fingerprint)``, distinct fingerprints -> ``(src, dst)``: a spanning forest for each
    bucket of the links at ``distance`` bits or fewer, which has the components of all links."""
    spark = prints.sparkSession
    masks = block_masks(prints.count(), distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def key(i: int, mask: int) -> Column:
        return F.struct(F.lit(i).alias("kind"), F.col("fingerprint").bitwiseAND(F.lit(mask)).alias("key"))

    keyed = prints.select("node", "fingerprint", F.explode(F.array(*[key(i, m) for i, m in enumerate(signed)])).alias("b"))
    keyed = keyed.select("b.kind", "b.key", "fingerprint", "node")
    dealt = keyed.repartition(shuffle_partitions(spark), "kind", "key").sortWithinPartitions("kind", "key")
    return dealt.mapInArrow(_bucket_links(distance), "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fingerprint long, component_id)``: documents whose fingerprints differ in ``distance`` bits or
    fewer are linked; ``component_id`` is the smallest id reachable by links, itself included.

    Equal fingerprints are one node, so copies are never expanded into pairs. Null, empty and wordless texts
    have fingerprint 0 and link like any other; a row without an id links nothing and takes the component of its
    fingerprint, if another row has it; an empty table gives no rows; other columns are not read.
    """
    marked = as_table(simhash(docs, id_col, text_col, shingle, seed).select(F.col(id_col).alias("_id"), "fingerprint"))
    nodes = as_table(marked.groupBy("fingerprint").agg(F.min("_id").alias("node")).where("node is not null"))
    parts = connected_components(hamming_links(nodes, distance))
    named = nodes.join(parts, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fingerprint", "left").select(F.col("_id").alias(id_col), "fingerprint", "component_id")


def limit_for(similarity: float, bits: int, spare: float = 1.28) -> int:
    """The Hamming distance that pairs of this Jaccard similarity keep within, but for those beyond ``spare`` deviations."""
    cosine = 2 * similarity / (1 + similarity)
    share = acos(cosine) / pi
    return round(bits * share + spare * sqrt(bits * share * (1 - share)))


def overlapping_blocks(n_prints: float, bits: int, distance: int, found: float = 0.97, seed: int = 7) -> list[list[int]]:
    """Sets of bits of which a pair at ``distance`` agrees on one at least with probability ``found``; closer pairs do
    more surely. The width follows the number of prints, so that unrelated ones seldom share a key."""
    width = max(10, ceil(log2(max(n_prints, 2))) - 3)
    both = (1 - distance / bits) ** width
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(bits, width, replace=False).tolist()) for _ in range(ceil(log(1 - found) / log(1 - both)))]


#: Sets of up to so many shingles meet by the least of them: a majority of few votes does not follow the angle.
_FEW = 64
_SPARE = 3.3


def _shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """``(_id, set)``: the distinct shingles' hashes in order; repeated rows of an id are told apart by their sets."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(np.array(shingle_hashes(t, shingle, seed), np.uint64)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["_id", "set"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "_id long, set array<long>")


def _set_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, seed: int, words: int) -> DataFrame:
    """``(_id, digest, n, fingerprint, least)``: digest, size and print of each shingle set. ``least`` has those hashes
    of a small set of which two sets of this similarity share one."""

    def run(batches):
        for batch in batches:
            rows, hashes, sizes = [], [], []
            prints = []
            texts = batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                found = np.unique(np.array(shingle_hashes(text, shingle, seed), np.uint64))
                few = found[: len(found) - ceil(similarity * len(found) - 1e-9) + 1] if len(found) <= _FEW / similarity else found[:0]
                rows.append((hashlib.blake2b(found.tobytes(), digest_size=16).digest(), len(found), few.tobytes()))
                hashes.append(found)
                sizes.append(len(found))
                if sum(sizes) >= _HASHES_AT_ONCE or i + 1 == len(texts):
                    prints += [p.tobytes() for p in majority_bits(np.concatenate(hashes), sizes, words)]
                    hashes, sizes = [], []
            digests, counts, least = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), pa.array(least, pa.binary())], ["_id", "digest", "n", "fingerprint", "least"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, "_id long, digest binary, n long, fingerprint binary, least binary")


def _bucket_groups(similarity: float, words: int, small: int = 24):
    """``(src, dst)`` for each bucket: every print with the least node that it reaches by prints near enough to link.

    Prints come as ``words`` words and the set's size. No pair leaves, so rows are no more than the bucket's own.
    """
    bits = BITS * words
    most = limit_for(similarity, bits, _SPARE)
    most_few = round(0.19 * bits + _SPARE * sqrt(0.19 * 0.81 * bits))  # from four shingles on, 3 in 16 bits differ at most

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(a[:, words], b[:, words]), np.maximum(a[:, words], b[:, words])
        return (low >= similarity * high - 1e-6) & (apart(a[:, :words], b[:, :words]) <= np.where(low <= _FEW, most_few, most))

    def links(group: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((cut, [len(group)])))
        order = np.lexsort((nodes, group))  # the first row that reaches others has their least node
        rows, nodes = rows[order], nodes[order]
        keep = np.flatnonzero((np.repeat(size, size) > 1) & (np.repeat(size, size) <= small))
        g, p, q = group[keep], [], []
        for lag in range(1, small):
            same = np.flatnonzero(g[lag:] == g[:-lag]) if len(g) > lag else np.empty(0, int)
            if not len(same):
                break
            same = same[near(rows[keep[same]], rows[keep[same + lag]])]
            p.append(same)
            q.append(same + lag)
        src, dst = [], []
        if p:
            root = least_reached(len(keep), np.concatenate(p), np.concatenate(q))
            src.append(nodes[keep[root]])
            dst.append(nodes[keep])
        for i in np.flatnonzero(size > small):
            left = np.arange(cut[i], cut[i] + size[i])
            while len(left) > 1:
                root, queue, left = left[0], [left[0]], left[1:]
                while queue and len(left):
                    ok = near(rows[left], rows[queue.pop(0)][None])
                    src.append(np.full(ok.sum(), nodes[root]))
                    dst.append(nodes[left[ok]])
                    queue += left[ok].tolist()
                    left = left[~ok]
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, dst))
        other = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[other]), pa.array(b[other])], ["src", "dst"])

    def read(column) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words + 1)

    return _by_bucket(read, links)


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` reaches over the pairs."""
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


def _few_links(stars: DataFrame) -> DataFrame:
    """``(src, dst)`` with the components of the buckets' stars: every node with the least of its roots, and that one with
    the node's other roots, which many nodes share. A node is once in a bucket of a kind, so its roots are no more than
    the kinds, and no join makes a row for each of them."""
    nodes = stars.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("roots"))
    meet = F.concat(F.array("node"), F.slice("roots", F.lit(2), F.size("roots")))
    return nodes.select(F.element_at("roots", 1).alias("src"), F.explode(meet).alias("dst"))


#: What a chunk of a group holds about: sets, and shingles in all.
_CHUNK_SETS, _CHUNK_SHINGLES = 512, 1 << 20


def _set_links(similarity: float):
    """A spanning forest of the links within a chunk of sets, or between two: each set is held by its exact Jaccard
    against those that it does not reach yet."""

    def run(table: pa.Table) -> pa.Table:
        node, role = table["node"].to_numpy(), table["role"].to_numpy()
        size = pc.list_value_length(table["set"]).to_numpy().astype(np.int64)
        _, code = np.unique(pc.list_flatten(table["set"]).to_numpy(), return_inverse=True)
        begin = np.cumsum(size) - size
        marked = np.zeros(len(code) + 1, bool)
        root = np.arange(len(node))
        lone = not role.any()
        second = np.flatnonzero(role == 1)
        src, dst = [], []
        for p in np.flatnonzero(role == 0).tolist():
            others = np.arange(p + 1, len(node)) if lone else second
            low, high = np.minimum(size[others], size[p]), np.maximum(size[others], size[p])
            others = others[(root[others] != root[p]) & (low >= similarity * high - 1e-6)]
            if not len(others):
                continue
            own, many = code[begin[p] : begin[p] + size[p]], size[others]
            starts = np.cumsum(many) - many
            marked[own] = True
            shared = np.add.reduceat(marked[code[np.repeat(begin[others] - starts, many) + np.arange(many.sum())]], starts, dtype=np.int64)
            marked[own] = False
            linked = others[shared >= (many + size[p] - shared) * similarity]
            if len(linked):
                roots, at = np.unique(root[linked], return_index=True)
                src.append(np.full(len(at), node[p]))
                dst.append(node[linked[at]])
                root[np.isin(root, roots)] = root[p]
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, dst))
        return pa.table({"src": a, "dst": b})

    return run


def _in_chunks(groups: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``(group, i, j, role, node, set)``: groups of sets cut into chunks by a hash; each pair of chunks, and each chunk
    with itself, is a task's work of its own, so a group of any size is spread and none is held whole."""
    sizes = groups.join(nodes.select("node", "n"), "node").groupBy("group").agg(F.greatest(F.count("*") / _CHUNK_SETS, F.sum("n") / _CHUNK_SHINGLES).alias("many"))
    large = as_table(sizes.where("many > 1").select("group", F.ceil("many").alias("chunks")))  # few: each fills a chunk at least
    rows = groups.join(F.broadcast(large), "group", "left").join(sets.select(F.col("_id").alias("node"), "set"), "node")
    chunks = F.coalesce("chunks", F.lit(1))
    rows = rows.select("group", "node", "set", F.pmod(F.xxhash64("node"), chunks).alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    return rows.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("role"), "node", "set")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, words: int = 4, seed: int = 42) -> DataFrame:
    """``(id, component_id)`` for documents whose sets of ``shingle``-word runs have a Jaccard ``similarity`` or more, or
    that are joined by such documents.

    Prints only find groups: what buckets tell may link, one through the other. Within a group every two sets that are
    not joined yet are compared whole (64-bit hashes), chunk by chunk; pairs are never made rows, but the links that
    join are. A distance that stands for a similarity of 0.8 is a sixth of all bits: disjoint pigeonhole blocks would be
    too narrow to part unrelated texts. Blocks overlap here and are enough for about 999 in 1000 pairs at the limit and
    more of closer ones. Small sets meet by their least shingles instead, which misses none. Null, empty and wordless
    texts are equal; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    marked = as_table(_set_prints(docs, id_col, text_col, shingle, similarity, seed, words))
    nodes = as_table(marked.groupBy("digest", "n", "fingerprint", "least").agg(F.min("_id").alias("node")).where("node is not null"))
    blocks = overlapping_blocks(nodes.count(), BITS * words, limit_for(similarity, BITS * words, 2.0), 0.995)

    def keys(batches):
        for batch in batches:
            whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1)
            node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            least = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            packed = np.concatenate((whole, np.ascontiguousarray(n.astype(np.int64)).view(np.uint8).reshape(len(n), 8)), axis=1)

            def rows(kind: int, key: np.ndarray, at: np.ndarray):
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int64)), pa.array(key), pa.array([p.tobytes() for p in packed[at]], pa.binary()), pa.array(node[at])], ["kind", "key", "fingerprint", "node"])

            at = np.flatnonzero(n > _FEW)
            on = np.unpackbits(whole[at], axis=1, bitorder="little")
            for kind, block in enumerate(blocks):
                yield rows(kind, on[:, block].astype(np.int64) @ (1 << np.arange(len(block), dtype=np.int64)), at)
            if any(map(len, least)):
                yield rows(-1, np.concatenate(least), np.repeat(np.arange(len(least)), [len(x) for x in least]))

    keyed = nodes.select("node", "fingerprint", "n", "least").mapInArrow(keys, "kind long, key long, fingerprint binary, node long")
    dealt = keyed.repartition(shuffle_partitions(spark), "kind", "key").sortWithinPartitions("kind", "key")
    near = _few_links(dealt.mapInArrow(_bucket_groups(similarity, words), "src long, dst long"))
    groups = as_table(connected_components(near).select("node", F.col("component").alias("group")))
    some = docs.select(id_col, text_col).join(groups.select(F.col("node").alias(id_col)), id_col, "left_semi")
    sets = _shingle_sets(some, id_col, text_col, shingle, seed).dropDuplicates()
    chunks = _in_chunks(groups, nodes, sets).groupBy("group", "i", "j")
    parts = connected_components(chunks.applyInArrow(_set_links(similarity), "src long, dst long"))
    named = nodes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return marked.select("_id", "digest").join(named, "digest", "left").select(F.col("_id").alias(id_col), F.coalesce("component_id", "_id").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the smallest id. Repeated rows of an id are
    one document; rows without an id stay."""
    found = similar_documents(docs, id_col, text_col, **more)
    return docs.join(found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), id_col, "left_anti").select(docs.columns)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
