import math
import random

import numpy as np
import pytest

from vesperline.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, node int"


def brute(rows, least):
    usable = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable.setdefault(i, np.array(v, np.float32).astype(float))
    ids = sorted(usable)
    links = {i: set() for i, _ in rows}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = usable[a], usable[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in links:
        seen, work = {i}, [i]
        while work:
            for n in links[work.pop()] - seen:
                seen.add(n)
                work.append(n)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA).repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, **more).collect()}


def corpus(seed, size, n=260):
    rng = np.random.default_rng(seed)
    rows, pick = [], random.Random(seed)
    for i in range(n):
        v = rng.normal(size=size)
        if i > 5 and i % 3 == 0:  # near the limit, on both sides, and far inside it
            base = np.array(pick.choice(rows)[1])
            noise = rng.normal(size=size)
            noise *= pick.choice((0.01, 0.3, 0.45, 0.4843, 0.5, 0.6)) * np.linalg.norm(base) / np.linalg.norm(noise)
            v = pick.choice((1.0, 3.0)) * (base + noise)
        if i > 5 and i % 11 == 0:
            v = np.array(pick.choice(rows)[1])
        rows.append((i * 7 % 1009, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("size,chunk", [(64, 16_384), (64, 20), (20, 16_384), (3, 30)])
def test_matches_brute_force(spark, size, chunk):
    rows = corpus(size + chunk, size)
    assert run(spark, rows, rows_a_chunk=chunk) == brute(rows, 0.9)


def test_odd_vectors_and_empty_table(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [math.nan, 1.0, 0.0]), (6, [math.inf, 1.0, 0.0])]
    rows += [(7, one), (8, one), (9, [1.0, 0.0]), (10, [1.0, -0.0, 0.0]), (11, [2.0, 0.0, 0.0]), (12, [-1.0, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows, 0.9)
    assert run(spark, []) == {}


def test_many_equal_vectors_are_one_class(spark):
    rows = [(i, [0.5, 0.25, -1.0, 2.0]) for i in range(400)] + [(1000 + i, [0.5, 0.25, -1.0, 2.0 + i / 1000]) for i in range(1, 60)]
    assert run(spark, rows, rows_a_chunk=16) == brute(rows, 0.9)


def test_repeated_ids_and_extreme_components(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1e200, 1e200]), (4, [1e-300, 1.1e-300]), (5, [-1e200, 1e200]), (None, [0.0, -1.0])], "vec_id long, embedding array<double>")
    rows = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embeddings.near_duplicates(df).collect())
    assert rows == [(0, 0, 0), (1, 0, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def test_a_thin_slab_below_a_dense_one(spark):
    rng = np.random.default_rng(7)
    hub = rng.normal(size=16)
    rows = [(i, [float(np.float32(x)) for x in hub + rng.normal(size=16) * (0.05 if i % 3 else 0.9)]) for i in range(300)]
    assert run(spark, rows, rows_a_chunk=16, block_width=8) == brute(rows, 0.9)
