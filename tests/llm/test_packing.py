import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vesperline.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, piece string, length int"


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = [
    None, "", " \n", "Hello, World!!! it's they'll 'tis O'Neil's", "a,b;c...d ###x### 'S don't.", "ÉCOLE école naïve é Ⅷ ²",
    "<|startoftext|> x<|endoftext|>y", "ΟΔΟΣ, ΟΔΟΣ ΣΑΣ! İstanbul ǅ", "tab\tand\x1cfile\x85next　wide", "日本語、テスト。 русский текст", "1234 5,6 7.8% a1b2",
    "İ. Aİ! İstanbulİ, \u05e9\u05c1. \ufb2a. \ufb2a, x\vy\fz \u00a0. \u3000! e\u0301. e\u0301\u0323, \u1e9b\u0323! \u0345. \u2126; \u212b.", "word " * 5000, "​zero", "😀 smile's", "x" * 3000,
]


def test_ids_equal_the_tokenizers(spark):
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS)], SCHEMA)
    rows = packing.token_pieces(df, PATH, keep_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(TEXTS):
        mine = [r for r in rows if r.doc_id == i]
        ids = plain(text)
        assert [x for r in mine for x in r.ids] == ids
        assert [r.start for r in mine] == list(range(0, len(ids), 4096))
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()) for k in range(0, len(ids), 4096)]


def test_words_kept_from_before_change_nothing():
    coder = packing.WordEncoder(PATH)
    texts = pa.array(TEXTS)
    first = [x.tolist() for x in coder.encode(texts)]
    assert first == [x.tolist() for x in coder.encode(texts)] == [packing.WordEncoder(PATH).encode(pa.array([t], pa.string()))[0].tolist() for t in TEXTS]
    assert first[1:3] == [x.tolist() for x in coder.encode(texts.slice(1, 2))] and coder.encode(texts.slice(0, 0)) == []


def test_ids_of_any_letters_and_marks_equal_the_tokenizers():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    alphabet = "aAzZ\u00c9\u0130\u0131\u00df\u01c5\u03a3\u03c2\u0416\u0587\u05d0\ufb2a\u0301\u0307\u0323\u093e\u0e33\u1e9e\u4e2d\U0001f600\U00010400.,!?;:'#-_ \t\n\v\f\x1c\x85\u00a0\u200b0\u0661\u2160\u00b2"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    coder = packing.WordEncoder(PATH)
    got = [x.tolist() for k in range(0, len(texts), 1000) for x in coder.encode(pa.array(texts[k : k + 1000]))]
    assert got == want


def test_a_bound_on_open_bins_closes_the_fullest():
    assert packing.best_fit([60, 70, 80, 20, 30, 40], 100, 2) == ([0, 1, 2, 1, 0, 3], [0, 0, 0, 70, 60, 0])
    assert packing.best_fit([60, 70, 80, 20, 30, 40], 100, 3) == ([0, 1, 2, 2, 1, 0], [0, 0, 0, 80, 70, 60])


def test_short_pieces_of_a_window_fill_what_its_long_ones_open(spark):
    rng = random.Random(9)
    rows = [(i, 0, min(4096, int(rng.lognormvariate(6.3, 1.1)) + 1)) for i in range(20_000)]
    out = packing.pack(spark.createDataFrame(rows + [(None, 0, 5), (7, None, None)], "doc_id long, piece int, length long"))
    got = out.groupBy("sequence_id").sum("length").collect()
    assert len(got) <= 1.001 * sum(r[2] for r in rows) / 4096 + 1
    assert packing.pack(out.drop("sequence_id", "offset").where("false")).count() == 0


@pytest.mark.parametrize("open_bins", [1, 3, 50, 5000])
def test_best_fit_is_gapless_within_capacity(open_bins):
    rng = random.Random(open_bins)
    lengths = [rng.choice((1, 5, 100, 100, rng.randrange(1, 101))) for _ in range(3000)]
    bins, offsets = packing.best_fit(lengths, 100, open_bins)
    full = {}
    for length, b, offset in zip(lengths, bins, offsets):
        assert full.get(b, 0) == offset
        full[b] = offset + length
        assert full[b] <= 100
    if open_bins == 5000:
        assert len(full) <= 1.02 * sum(lengths) / 100 + 1


def test_packing_rows(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["word"] * rng.choice((0, 3, 40, 700, 5000))), "x", 0) for i in range(400)] + [(7, None, "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = packing.token_pieces(df, PATH)
    out = packing.pack(pieces, tokens_per_group=100_000).collect()
    assert len(out) == pieces.count()
    sequences = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert sequences.get(r.sequence_id, 0) == r.offset
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096
    assert len(sequences) <= 1.03 * sum(r.length for r in out) / 4096 + 3
    assert packing.pack_documents(df.where("false"), PATH).count() == 0
