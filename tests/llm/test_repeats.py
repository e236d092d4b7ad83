import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vesperline.llm import _repeats, phrase_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, spans string, _text int"


def brute(rows, length, split, join):
    seen, out = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if i in out:
            continue
        units = split(text or "")
        gone = [False] * len(units)
        for p in range(len(units) - length + 1):
            key = tuple(units[p : p + length])
            if key in seen:
                gone[p : p + length] = [True] * length
            seen.setdefault(key, (i, p))
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(units), sum(gone), spans, join([u for u, g in zip(units, gone) if not g]))
    return out


def as_bytes(text):
    return list(text.encode())


def as_words(text):
    return text.encode().split()


def corpus(seed):
    """Copies, copies with edits, passages that many texts share, loops, constant runs, long and empty texts."""
    rng = random.Random(seed)
    vocab = ["a", "of", "thé", "words", "ing", "longer", "zz", "Über", "x1"] + [f"t{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, other = say(70), say(33)
    rows = []
    for i in range(60):
        words = say(rng.choice((3, 30, 120, 400)))
        if i % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(20) :]
        if i % 7 == 0:
            words += other + say(2) + other[: rng.randrange(5, 33)]
        if i % 5 == 0 and rows:
            words = rng.choice(rows)[1].split()
            if i % 2:
                words[rng.randrange(len(words))] = "EDIT"
        rows.append((i * 3, (" " if i % 2 else "\n").join(words)))
    rows += [(1, None), (2, ""), (4, " "), (5, "ab" * 400), (7, "q " * 300), (8, "q" * 99), (10, "q" * 100), (11, "q" * 700)]
    rows += [(13, " ".join(say(9) * 40)), (14, " ".join(passage))]
    rng.shuffle(rows)
    return rows


def run_bytes(spark, rows, length, width, crowd=512, parts=3):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(parts)
    out = suffix_dedup.remove_repeats(df, length, width, crowd).collect()
    return [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, list(r.kept))) for r in out]


def run_words(spark, rows, length, width, crowd=512, parts=3):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(parts)
    out = phrase_dedup.remove_passages(df, length, width, crowd).collect()
    return [(r.doc_id, (r.n_words, r.n_removed, r.kept)) for r in out]


@pytest.mark.parametrize("crowd", [512, 1])
def test_bytes_match_brute_force(spark, crowd):
    rows = corpus(crowd)
    assert dict(run_bytes(spark, rows, 100, 24, crowd)) == brute(rows, 100, as_bytes, list)


@pytest.mark.parametrize("crowd", [512, 1])
def test_words_match_brute_force(spark, crowd):
    rows = corpus(crowd + 1)
    want = {i: (n, gone, b" ".join(kept).decode()) for i, (n, gone, _, kept) in brute(rows, 20, as_words, list).items()}
    assert dict(run_words(spark, rows, 20, 7, crowd)) == want


def test_long_texts_in_pieces_and_small_flushes(monkeypatch):
    rows = sorted(corpus(5)[:40], key=lambda r: r[0])
    for units_at_once in (150, 1 << 20):
        monkeypatch.setattr(_repeats, "_UNITS_AT_ONCE", units_at_once)
        config = _repeats.Config(100, 24, suffix_dedup.byte_units)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.string())], ["a", "b"])
        parts = [_repeats._phrases(h, config) for h in _repeats._pieces(batch, config)]
        covered = {}
        for p in parts:
            for d, s, n in zip(p.doc.tolist(), p.start.tolist(), p.size.tolist()):
                covered.setdefault(d, []).extend(range(s, s + n))
        for d, text in rows:
            assert sorted(covered.get(d, [])) == list(range(max(0, len((text or "").encode()) - 99)))


def bucket_of(texts, gram_of):
    """The one bucket of some documents whose every text is asked for as a word of one trigger or another."""
    config = _repeats.Config(100, 24, suffix_dedup.byte_units)
    kind = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("gram", pa.int64())]))
    asked = [[{"kind": _repeats.BY_TRIGGER, "start": at, "end": min(at + 176, len(t)), "gram": gram_of(i, at)} for at in range(0, len(t) - 99, 77)] for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(asked, kind)], ["a", "b", "c"])
    return config, pa.Table.from_batches(list(_repeats._map_words(config, 1)([batch])))


def test_a_bucket_needs_no_more_memory_than_its_parts(monkeypatch):
    monkeypatch.setattr(_repeats, "_TEXTS_AT_ONCE", 1 << 17, raising=False)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=8000)) for _ in range(100)] * 2
    config, bucket = bucket_of(texts, lambda i, at: i % 100 << 20 | at)
    tracemalloc.start()
    found = _repeats._reduce(config, suffix_dedup.suffix_classes)(bucket).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(map(len, texts))
    assert bucket.nbytes > 2 * size and peak < 25 * size  # all words at once took over 100 bytes for each of a text
    assert sum(e - s for s, e in zip(found["start"], found["end"])) >= size / 2 and min(found["_id"]) == 100


def test_parts_of_a_bucket_give_what_the_whole_gives(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc ", k=rng.randrange(100, 900))) for _ in range(40)]
    texts += [t[: len(t) // 2] + "X" + t[len(t) // 2 + 1 :] for t in texts]
    found = []
    for at_once in (1, 2000, 1 << 20):
        monkeypatch.setattr(_repeats, "_TEXTS_AT_ONCE", at_once)
        config, bucket = bucket_of(texts, lambda i, at: i % 40 << 10 | at)
        rows = _repeats._reduce(config, suffix_dedup.suffix_classes)(bucket).to_pylist()
        found.append({(r["_id"], b) for r in rows for b in range(r["start"], r["end"])})
    assert found[0] == found[1] == found[2] and len(found[0]) > 5000

    n = 5000
    code = np.array([rng.randrange(n) for _ in range(n)], np.uint64)
    p = _repeats.Phrases((code % 700).astype(np.uint32), code, np.array([rng.randrange(900) for _ in range(n)]), np.arange(n).astype(np.uint32), np.ones(n, np.uint32))
    spans = []
    for at_once in (1, 64, 1 << 18):
        monkeypatch.setattr(_repeats, "_PHRASES_AT_ONCE", at_once)
        rows = pa.Table.from_batches(_repeats._phrase_spans(p, config._replace(crowd=5))).to_pylist()
        covered = {(r["_id"], b) for r in rows if r["kind"] == _repeats.REPEATED for b in range(r["start"], r["end"])}
        spans.append((covered, sorted(tuple(r.values()) for r in rows if r["kind"] != _repeats.REPEATED)))
    assert spans[0] == spans[1] == spans[2] and {r[1] for r in spans[0][1]} == {_repeats.BY_TRIGGER, _repeats.BY_WINDOW}


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "every word of this line is repeated in another row of the table " * 4
    rows = [(1, text), (1, text), (None, text), (None, None)]
    found = run_words(spark, rows, 20, 7)
    assert sorted(f[1][1] for f in found if f[0] is None) == [0, 0]
    ones = [f[1] for f in found if f[0] == 1]
    assert ones[0] == ones[1] == (52, 39, " ".join(text.split()[:13]))
    assert run_words(spark, [], 20, 7) == [] and run_bytes(spark, [], 100, 24) == []


def test_ids_at_the_ends_of_the_range(spark):
    text = "some words that both of the documents hold in full and that are long enough to be found by either of the two operators"
    rows = [(-(2**63), text), (2**63 - 1, text), (-5, text)]
    found = dict(run_bytes(spark, rows, 100, 24))
    assert [found[i][1] for i in (-(2**63), -5, 2**63 - 1)] == [0, len(text), len(text)]


def test_cuts_widen_to_whole_characters(spark):
    genuine, body = "keep \ufffd here ", "".join(chr(0x110 + i) for i in range(60))
    # U+0101 and U+0141 end in the same byte, U+1D01 and U+1D05 begin with the same two: cuts fall inside them
    rows = [(1, "\u0101" + body + "\u1d01"), (2, genuine + "\u0141" + body + "\u1d05\ufffd end"), (3, "clean \ufffd text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    whole = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(df, whole_characters=True).collect()}
    assert plain[2] == genuine.encode() + b"\xc5" + b"\x85" + "\ufffd end".encode()
    assert whole == {1: rows[0][1], 2: genuine + "\ufffd end", 3: "clean \ufffd text"}
