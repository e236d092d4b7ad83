import random
from collections import Counter

import numpy as np
import pytest

from vesperline.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, score string, code string"


def plain_grams(text):
    import unicodedata

    chars = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    joined = " " + " ".join(chars.split()) + " "
    return Counter(g for n in (1, 2, 3) for i in range(len(joined) - n + 1) if (g := joined[i : i + n]) != " ")


def code_of(gram):
    return sum(ord(c) << 21 * (2 - i) for i, c in enumerate(gram))


@pytest.mark.parametrize("text", ["Ab ab", "x", " --one, two!two?? ", "Straße İzmir é é 日本語 \U0001f600 Ж", "a1b2", "ﬁ ²a"])
def test_counts_of_runs(text):
    codes, counts, lettered = language.grams(text)
    assert lettered and dict(zip(codes.tolist(), counts.tolist())) == {code_of(g): n for g, n in plain_grams(text).items()}
    assert (np.diff(codes) > 0).all()


@pytest.mark.parametrize("text", [None, "", " 12 ½ Ⅷ _ ́", "😀"])
def test_no_letter_is_undetermined(text):
    assert language.Profiles({"en": np.array([code_of("e")])}, 4).nearest(text) == ("und", 0.0)


def plain_nearest(ranked, size, text):
    own = [g for g, _ in sorted(plain_grams(text).items(), key=lambda x: (-x[1], code_of(x[0])))][:size]
    d = {lang: sum(abs(top.index(g) - i) if g in top else size for i, g in enumerate(own)) for lang, top in ranked.items()}
    best = min(sorted(d), key=lambda lang: d[lang])
    other = min([d[x] for x in d if x != best], default=size * len(own))
    return best, (other - d[best]) / other if other else 0.0


WORDS = {"aa": "the and of house water green", "bb": "der und von haus wasser grün", "cc": "le et de maison eau vert"}


def sample(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randrange(1, 40))), lang, "s", "x", "y") for i, lang in enumerate(rng.choices(list(WORDS), k=n))]


def test_whole_operator_equals_brute_force(spark):
    rows = sample(5, 300) + [(None, "the water", "bb", "s", "x", "y"), (7001, None, "aa", "s", "x", "y"), (7002, "-", None, "s", "x", "y"), (7003, "the and", None, "s", "x", "y"), (7003, "the and", None, "s", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    import zlib

    counts = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2:
            counts.setdefault(r[2], Counter()).update(plain_grams(r[1]))
    ranked = {lang: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code_of(x[0])))][:60] for lang, c in counts.items()}
    out = language.identify(df, language.train(df, size=60)).collect()
    want = [(r[0], *(plain_nearest(ranked, 60, r[1]) if any(c.isalpha() for c in r[1] or "") else ("und", 0.0))) for r in rows]
    assert sorted(((r.doc_id, r.lang_pred, round(r.score, 9)) for r in out), key=str) == sorted(((i, p, round(s, 9)) for i, p, s in want), key=str)


def test_a_bounded_sample_keeps_rare_languages_whole(spark):
    rows = sample(6, 400) + [(9000 + i, "zebra quagga", "rare", "s", "x", "y") for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    profiles = language.train(df, most_rows=40)
    out = language.identify(df, profiles).collect()
    right = {r[0]: r[2] for r in rows}
    assert profiles.names == ["aa", "bb", "cc", "rare"]
    assert sum(r.lang_pred == right[r.doc_id] for r in out) >= 0.97 * len(out)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "the", None, "s", "x", "y")], SCHEMA)
    assert [tuple(r) for r in language.identify(df, language.train(df)).collect()] == [(1, "und", 0.0)]
    assert language.identify(df.where("false"), language.train(df.where("false"))).count() == 0
