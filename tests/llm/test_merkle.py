import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vesperline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, gid string, idx string, hash string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(hashes):
    """Levels of a tree, each a list of hashes, the root's last."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i : i + 3]) for i in range(0, len(now), 3)])
    return levels


def siblings(levels, at):
    """[(left, right)] from a place at the bottom up to the root."""
    out = []
    for level in levels[:-1]:
        run = level[at - at % 3 : at - at % 3 + 3]
        out.append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        at //= 3
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(*row[:5]), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    found = []
    for k, s in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = siblings(trees[s], at) + siblings(top, k)
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            h = leaf_of(*row[:4], text)
            for left, right in path:
                h = sha(left, h, right)
            root = top[-1][0]
            found.append((row[0], leaf, trees[s][-1][0], root, sha(*[x + y for x, y in path]), h, h == root))
    return found


def made(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.manifest(df, tampered)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified")
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("seed,n", [(1, 1), (2, 4), (3, 200)])
def test_all_hashes_equal_brute_force(spark, seed, n):
    rng = random.Random(seed)
    sources = [None, "", "a", "é", "Z", "z", "hot", "hot", "hot"]
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([3, None]), rng.choice([None, "", "one\ntwo", "ü\n", "three"])) for i in range(n)]
    rows += [(None, "hot", None, None, "\n"), (None, "hot", None, None, "\n"), (0, "hot", "en", 1, "again"), (0, "hot", "en", 1, "again")] if n > 100 else []
    assert made(spark, rows) == sorted(brute(rows), key=str)


def test_only_changed_texts_fail(spark):
    rows = [(i, "s", "en", 1, "a\nb" if i % 3 else "ab") for i in range(60)]
    for doc_id, *_, verified in made(spark, rows):
        assert verified == (doc_id % 3 == 0 or zlib.crc32(str(doc_id).encode()) % 2 == 1)


def test_an_empty_table(spark):
    assert made(spark, []) == []


def test_binary_trees_take_the_same_way(spark):
    df = spark.createDataFrame([(i, "s", "en", 1, str(i)) for i in range(11)], "doc_id long, source string, lang string, n_chars long, text string")
    out = merkle.manifest(df, arity=2).collect()
    assert all(r.verified for r in out) and {len(r.path) for r in out} == {4}


def test_plan_does_not_grow_with_the_levels(spark):
    """The driver holds the plan of one level and no level's rows."""
    plans = []
    for n in (10, 200):
        rows = spark.range(n).selectExpr("id as doc_id", "'s' as source", "'en' as lang", "1L as n_chars", "cast(id as string) as text")
        plans.append(merkle.manifest(rows)._jdf.queryExecution().executedPlan().toString())
    assert plans[0].count("Join") == plans[1].count("Join") <= 2
    assert "BroadcastHashJoin" not in plans[1]
