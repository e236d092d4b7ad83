"""Every operator over tables with nulls anywhere, repeated rows, clashing extra columns, and none at all."""

import pytest
from pyspark.sql import functions as F

from vesperline.llm import embeddings, language, media, merkle, packing, phrase_dedup, secret_scan, sentence_pieces, simhash, suffix_dedup, toxicity, wrappers

TEXTS = [None, "", " ", "token: abcdefg", "one two three four five six " * 6, "one two three four five six " * 6, "é" * 90]
CLASHING = ["_id", "_text", "kept", "spans", "rest", "found", "fingerprint", "component_id", "node", "n_bytes", "n_words", "n_removed", "media", "feature", "score", "predicted", "host", "layout", "blocks", "tree", "bucket", "data"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


OPERATORS = {
    "suffix_dedup": lambda d: suffix_dedup.remove_repeats(d, carry=["text", "rest", "kept"]).drop("text"),
    "simhash": simhash.near_duplicates,
    "toxicity": lambda d: toxicity.score(d, toxicity.Model({"=bad": 4.0})),
    "secret_scan": secret_scan.scan_secrets,
    "media": media.media_digest,
    "phrase_dedup": phrase_dedup.remove_passages,
    "merkle": lambda d: merkle.manifest(d, fields=["doc_id", "spans", "text"], group="spans"),
    "language": lambda d: language.identify(d, language.train(d.withColumn("lang", F.when(F.length("text") > 4, "en")))),
    "wrappers": lambda d: wrappers.main_text(d.withColumn("url", F.lit("http://a.example/")), "doc_id", "url", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(docs, name):
    out = OPERATORS[name](docs)
    assert out.count() == docs.count()
    ids = sorted((r[0] for r in out.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids == [0, 1, 2, 3, 3, 4, 5, 6, None, None]
    assert OPERATORS[name](docs.where("false")).count() == 0


def test_stages_keep_clashing_columns(docs):
    for out in (simhash.drop_similar(docs), secret_scan.redact_secrets(docs), toxicity.drop_toxic(docs, toxicity.Model({}))):
        assert out.columns == docs.columns and out.count() >= 6


def test_packing_and_pieces_survive_odd_tables(docs):
    public = pytest.importorskip("public_tokenizers")
    odd = docs.select("*", *[F.lit(7).alias(c) for c in ("_group", "sequence_id", "offset", "piece", "ids")])
    out = packing.pack_documents(odd, public.path("word_bpe_49k.json"))
    assert out.where("piece = 0").count() == docs.count() and packing.pack_documents(odd.where("false"), public.path("word_bpe_49k.json")).count() == 0
    again = packing.pack(out.select("*", F.lit("x").alias("_group")))
    assert again.count() == out.count() and again.columns.count("sequence_id") == 1
    model = public.path("piece_bpe_32k.model")
    coded = sentence_pieces.encode_documents(odd, model, keep_ids=True)
    assert coded.count() == docs.count() and coded.where("round_trip").count() == docs.count()
    rows = [(1, [1, 99_999_999]), (2, [-1]), (3, None), (4, []), (5, [None])]
    back = sentence_pieces.decode_documents(docs.sparkSession.createDataFrame(rows, "doc_id long, ids array<int>"), model)
    assert {r.doc_id: r.text for r in back.collect()} == {1: None, 2: None, 3: None, 4: "", 5: None}


def test_vectors_survive_odd_tables(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in CLASHING if c != "component_id"], F.lit(3).alias("n_links"))
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).select("vec_id", "n_links").collect())
    assert got == [(1, 1), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 0)] and embeddings.near_duplicates(df.where("false")).count() == 0


def test_broken_media_are_null(spark):
    good = media.store_media(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first().media
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFF"), (5, good[:30]), (6, b"x" * 100), (7, good[:20] + b"\xff\xff" + good[22:])]
    out = {r.doc_id: r.pcm for r in media.decode_media(spark.createDataFrame([(i, b and bytearray(b)) for i, b in rows], "doc_id long, media binary")).collect()}
    assert [i for i, pcm in out.items() if pcm is not None] == [1]
