import random

import numpy as np
import pytest

from vesperline.llm import sentence_pieces as sp

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    "", "a    b", "        x", "  ", "\t\n ", "ﬁ Å ½ ＡＢ", "<s>hi</s>", "　x", "\x00a", "a \r\n b", "\n", "\n\n a\n",
    "The quick brown fox, jumps over the lazy dog's back.", "naïve café 日本語 😀😀", "x" * 500, "if (a) {\r\n\treturn();\r}", " " * 40 + "end",
]


def library(text):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)


def test_suffix_array_and_ranges_match_plain_search():
    pieces = sp.Pieces(PATH)
    text = "▁the cat▁then"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    order = sp.suffix_array(codes, pieces.longest)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i : i + pieces.longest])
    place, length, piece = sp.edges(codes, pieces)
    want = sorted((i, len(t), k) for k, t in enumerate(pieces.texts) for i in range(len(text)) if text.startswith(t, i))
    assert list(zip(place.tolist(), length.tolist(), piece.tolist())) == want


def test_ids_and_text_equal_the_librarys(spark):
    rng = random.Random(1)
    alphabet = ["the", "tion", " ", "  ", "\n", "é", "ing", "x", "\r", ";", ")", "12", "Über", "ñ", "中", "e", "a", "th"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    rows = [(i, t, "x", 0) for i, t in enumerate(texts)] + [(len(texts), None, "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = sp.encode_documents(df, PATH, keep_ids=True)
    found = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(texts):
        assert found[i].ids == library(text), repr(text)
        assert found[i].round_trip and found[i].n_tokens == len(found[i].ids)
    assert found[len(texts)].n_tokens == 0
    assert {r.doc_id: r.text for r in sp.decode_documents(out, PATH).collect()} == {i: t or "" for i, t, *_ in rows}
    assert sp.encode_documents(df.where("false"), PATH).count() == 0


def test_a_space_mark_in_the_text_does_not_come_back(spark):
    df = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    row = sp.encode_documents(df, PATH, keep_ids=True).first()
    assert row.ids == library("a▁b") and not row.round_trip


def test_long_segments_equal_the_librarys_and_take_little():
    import time

    rng = random.Random(4)
    alphabet = ["the", "tion", "é", "ing", "x", ";", "12", "Über", "中", "文", "e", "a", "th", "st", "😀", "an"]
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (100, 300, 300, 2000)]
    texts.append("".join(rng.choice("ABCDEFabcdefghijklmnop0123456789+/") for _ in range(60_000)))
    coder = sp.Codec(PATH)
    began = time.process_time()
    got = coder.encode([f"{t} and {t}" for t in texts])
    assert time.process_time() - began < 60
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library(f"{t} and {t}") for t in texts]
