import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from vesperline.llm import packing, secret_scan, simhash, toxicity

pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = ({" ".join(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


def corpus():
    rng = random.Random(1)
    vocab = [a + b + c for a in ("ba", "ko", "ri", "te", "mu") for b in ("lo", "ma", "ni", "") for c in ("s", "n", "ta", "ru", "")]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = say(60)
    rows = {}
    for i in range(240):
        words = say(rng.randrange(60, 200))
        if i % 6 == 0:
            for _ in range(6):
                words.insert(rng.randrange(len(words)), "scum" + rng.choice("abcde"))
        if i % 10 == 1:
            words += shared
        if i % 15 == 2:
            words.append('password: "hunter2hunter2"')
        rows[i] = " ".join(words)
    copies = {}
    for i in range(1, 240, 8):
        words = rows[i].split()
        words[rng.randrange(len(words))] = "edited"
        copies[i] = 1000 + i
        rows[1000 + i] = rows[i] if i % 3 == 0 else " ".join(words)
    rows[5000], rows[5001] = None, ""
    return rows, copies, shared


def test_stages_against_plain_versions(spark, tmp_path):
    rows, copies, shared = corpus()
    toxic = {i for i, t in rows.items() if "scum" in (t or "")}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r.text for r in docs.collect()} if name != "best_fit_packing" else None
        if after is not None:
            assert docs.columns == corpus_pipeline.COLUMNS and docs.schema["n_chars"].dataType.simpleString() == "bigint"
            assert len(after) == docs.count()
        if name == "toxicity":
            assert set(after) == set(before) - toxic
        elif name == "simhash_near_dedup":
            gone = set(before) - set(after)
            for i in gone - {5001}:
                assert any(j < i and jaccard(before[i], before[j]) >= 0.6 for j in after if before[j]), i
            assert {c for i, c in copies.items() if c in before and jaccard(before[i], before[c]) >= 0.85} <= gone
            assert 5000 in after and 5001 in gone  # null and empty texts are alike
        elif name == "suffix_array_dedup":
            seen = set()
            for i in sorted(before):
                data = (before[i] or "").encode()
                removed = [False] * len(data)
                for p in range(len(data) - 99):
                    if data[p : p + 100] in seen:
                        removed[p : p + 100] = [True] * 100
                    seen.add(data[p : p + 100])
                kept = bytes(b for b, r in zip(data, removed) if not r).decode()
                assert (after[i] or "") == kept
            assert sum(" ".join(shared) in (t or "") for t in after.values()) == 1
        elif name == "secret_scans":
            assert after == {i: secret_scan.redacted_text(t, "[secret]") for i, t in before.items()}
            assert not any("hunter2" in (t or "") for t in after.values())
        else:
            pieces = docs.collect()
            coder = packing.encoder(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
            assert sum(r.length for r in pieces) == sum(len(x) + 1 for x in coder.encode(pa.array(before.values(), pa.string())))
            assert {r.doc_id for r in pieces} == set(before)
        before = after


def test_cut_characters_go_whole(spark):
    text = "é" * 200
    rows = [(1, "x" + text, "", "", 0), (2, text + "y", "", "", 0), (3, "a�b", "", "", 3)]
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert out[3] == ("a�b", 3) and out[2] == ("y", 1) and out[1][1] == len(out[1][0])


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for stage in (corpus_pipeline.without_near_duplicates, corpus_pipeline.without_repeats, corpus_pipeline.without_secrets, corpus_pipeline.packed):
        assert stage(spark, empty, "").count() == 0
    assert toxicity.drop_toxic(empty, toxicity.Model({})).count() == 0


def test_wide_blocks_find_pairs_at_the_limit():
    limit = simhash.limit_for(0.8, 256)
    blocks = simhash.overlapping_blocks(200_000, 256, limit)
    rng = random.Random(2)
    hit = sum(any(not flips & set(b) for b in blocks) for flips in (set(rng.sample(range(256), limit)) for _ in range(2000)))
    assert hit >= 0.9 * 2000


def families(rng, n, tail):
    """Texts at about 0.65 to each other in pairs whose last ``tail`` words differ."""
    say = lambda k: [f"w{rng.randrange(90000)}" for _ in range(k)]
    base, rows = say(300), {}
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(0, 260, 6), 12):
            words[at] = say(1)[0]
        rows[2 * i], rows[2 * i + 1] = " ".join(words), " ".join([*words[: 300 - tail], *say(tail)])
    return rows


def test_partners_in_a_crowded_bucket_stay_linked(spark):
    rows = families(random.Random(3), 300, 27)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    parts = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    prints = {r.doc_id: np.frombuffer(r.fingerprint, np.uint64)[None] for r in simhash.simhash(df, shingle=5, words=8).collect()}
    blocks = simhash.overlapping_blocks(600, 256, simhash.limit_for(0.8, 256))
    on = {i: np.unpackbits(p.view(np.uint8), bitorder="little") for i, p in prints.items()}
    meet = lambda i: any((on[i][b] == on[i + 1][b]).all() for b in blocks)
    sure = [i for i in range(0, 600, 2) if jaccard(rows[i], rows[i + 1]) >= 0.8 and simhash.apart(prints[i], prints[i + 1])[0] <= 68 and meet(i)]
    assert len(sure) > 50 and [i for i in sure if parts[i] != parts[i + 1]] == []


def test_links_are_exact_at_the_limit_both_ways(spark):
    rng = random.Random(8)
    rows = families(rng, 120, 27)
    say = lambda k: [f"w{rng.randrange(90000)}" for _ in range(k)]
    for i in range(1000, 1600, 2):  # isolated pairs of small and larger sets from 0.7 to 0.9
        words = say(rng.choice((8, 14, 40, 68, 90, 200)))
        rows[i], rows[i + 1] = " ".join(words), " ".join(words[: -max(1, round(len(words) * rng.uniform(0.05, 0.17)))] + say(rng.randrange(3)))
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    parts = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    want = {i: i - i % 2 if jaccard(rows[i - i % 2], rows[i - i % 2 + 1]) >= 0.8 else i for i in rows}
    assert 100 < sum(i != c for i, c in want.items()) < 400
    assert parts == want


def test_groups_cut_into_chunks_keep_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK_SETS", 16)
    rows = families(random.Random(9), 60, 27)
    rows |= {1000 + k: " ".join(rows[0].split()[k:]) for k in range(0, 150, 3)}  # a chain, its ends far apart
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    parts = {r.doc_id: r.component_id for r in simhash.similar_documents(df).collect()}
    want = {i: i for i in rows}
    words = {i: t.split() for i, t in rows.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    linked = [(a, b) for a in rows for b in rows if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(60):
        for a, b in linked:
            want[a] = want[b] = min(want[a], want[b])
    assert len(set(want.values())) < 100 and parts == want


def test_a_bucket_sends_no_pairs():
    """Sets that are alike, but short of the limit, leave a bucket as rows of one group and not as their pairs."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 32, np.uint8)
    prints = [(base ^ np.packbits(rng.random(256) < 0.1)).tobytes() + np.int64(200).tobytes() for _ in range(500)]
    for size in (500, 20):
        kind = [pa.array(np.arange(500) // size), pa.array(np.zeros(500, np.int64))]
        batch = pa.RecordBatch.from_arrays([*kind, pa.array(prints, pa.binary()), pa.array(np.arange(500) + 7)], ["kind", "key", "fingerprint", "node"])
        found = [r for b in simhash._bucket_groups(0.8, 4)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns))]
        assert len(found) == 500 - 500 // size and {dst for _, dst in found} | {src for src, _ in found} == set(range(7, 507))
        assert all(src == (dst - 7) // size * size + 7 for src, dst in found)


def test_a_node_in_many_buckets_sends_few_links(spark, monkeypatch):
    """A group of near copies meets in dozens of buckets; its components are not made of a link for each."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(90000)}" for _ in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(4):
            words[rng.randrange(300)] = f"x{rng.randrange(90000)}"
        rows.append((i, " ".join(words)))
    counts, plain = [], simhash.connected_components

    def counted(edges):
        counts.append(edges.distinct().count())
        return plain(edges)

    monkeypatch.setattr(simhash, "connected_components", counted)
    out = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in out.collect()} == {0} and 399 <= counts[0] <= 3 * 400


def test_few_links_have_the_components_of_the_stars(spark):
    rng = random.Random(6)
    stars = {(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(250)) if a < b}
    df = spark.createDataFrame([*stars, *list(stars)[:50]], "src long, dst long")
    parts = [{r.node: r.component for r in simhash.connected_components(e).collect()} for e in (df, simhash._few_links(df))]
    assert parts[0] == parts[1] and len(parts[0]) > 100
