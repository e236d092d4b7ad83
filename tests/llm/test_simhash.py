import random
import re

import xxhash

from vesperline.llm import simhash
from vesperline.llm._components import connected_components

SCHEMA = "doc_id long, text string, fingerprint string, _id int"


def _brute(rows):
    prints = {}
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        parts = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (prints[i], label[i]) for i in prints}


def _run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(df).collect()}


def test_matches_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(20):
        words = [rng.choice(vocab) for _ in range(200)]
        for copy in range(5):
            edited = list(words)
            for _ in range(copy // 2):
                edited[rng.randrange(200)] = rng.choice(vocab).upper()
            rows.append((base * 10 + copy, " ".join(edited)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE two"), (905, "é x " * 9)]
    assert _run(spark, rows) == _brute(rows)


def test_rows_without_an_id_are_kept(spark):
    rows = [(None, "alone in the table"), (None, "same words here"), (4, "same words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id is None, r.component_id or -1) for r in simhash.near_duplicates(df).collect()) == [(False, 4), (True, -1), (True, 4)]
    assert simhash.drop_similar(df).count() == 3


def test_empty_table_and_many_copies(spark):
    assert _run(spark, []) == {}
    rows = [(i, "same text over and over again") for i in range(500)]
    assert {c for _, c in _run(spark, rows).values()} == {0}


def test_more_blocks_find_the_same_links(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = list(dict.fromkeys([b ^ sum(1 << x for x in rng.sample(range(64), k)) for b in base for k in range(5)]))
    for n in (2, 1 << 20, 1 << 27, 1 << 31):
        masks = simhash.block_masks(n, 4)
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 4:
                    assert any(a & m == b & m for m in masks)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    found = {r.node: r.component for r in connected_components(df).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}
    assert connected_components(df.where("false")).count() == 0
