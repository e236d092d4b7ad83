import itertools
import random
import zlib

import numpy as np

from vesperline.llm import toxicity as tox


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        emission, moves = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = np.exp(sum(e for e, s in zip(emission, path) if s) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total = sum(weight.values())
        want = [sum(w for p, w in weight.items() if p[t]) / total for t in range(n)]
        assert np.allclose(tox.marginals(emission, moves), want)


def test_plain_sentences_count_like_any_other():
    model = tox.Model({"=bad": 5.0}, moves=np.array([[0.5, -0.2], [0.1, 0.3]]))
    text = "One two three. Bad word here!\nfour five"
    total, top, words, spans = tox.Scorer(model).text(text, offsets=True)
    base, hit = -6.0, -6.0 + 2.0 * 5.0
    parts = [tox.marginals(np.array(e), model.moves) for e in ([base] * 3, [hit, base, base], [base] * 2)]
    assert np.isclose(total, sum(p.sum() for p in parts)) and np.isclose(top, max(p.max() for p in parts)) and words == 8
    assert [text[s:e] for s, e, _ in spans] == ["Bad"]


def test_fit_raises_the_likelihood_of_the_labels():
    rng = random.Random(2)
    sentences = []
    for _ in range(300):
        label = rng.random() < 0.5
        x = np.array([(1.0, 4.0 if label and rng.random() < 0.4 else 0.0, 0.0, 0.0) for _ in range(rng.randrange(1, 9))])
        sentences.append((label, x, 1.0))
    weights, moves = tox.fit_field(sentences, tox.Model({}))
    assert tox.marginals(np.array([[1, 4.0, 0, 0], [1, 0, 0, 0]]) @ weights, moves)[0] > 0.9
    assert tox.marginals(np.array([[1, 0.0, 0, 0]] * 2) @ weights, moves).max() < 0.1


def corpus(rng, n):
    clean = [a + b + c for a in ("ba", "ko", "ri", "te") for b in ("lo", "ma", "ni") for c in ("s", "n", "ta", "ru")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words)), rng.choice(("Scum", "vequ" + rng.choice(clean))))
        docs.append((i, " ".join(words).replace("lota", "lota.")))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = corpus(random.Random(3), 900)
    # labels of held-out rows and nulls must not matter
    wrong = [(i, q, (1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    extra = [(5000, 1, None), (None, 1, 1)]
    frame = spark.createDataFrame(docs + [(7000, None), (7001, ""), (None, "Scum")], "doc_id long, text string")
    runs = []
    for some in (labels, wrong):
        model = tox.train(frame, spark.createDataFrame(some + extra, "doc_id long, quality int, toxic int"))
        runs.append({r.doc_id: (r.score, r.predicted) for r in tox.score(frame, model).collect()})
    assert runs[0] == runs[1]
    truth = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(runs[0][i][1] == t for i, t in truth.items())
    assert right >= 0.97 * len(truth) and len(truth) > 150
    assert runs[0][7000] == runs[0][7001] and runs[0][7000][1] == 0
    assert tox.score(frame.where("false"), tox.Model({})).count() == 0


def test_without_both_labels_nothing_is_toxic(spark):
    frame = spark.createDataFrame([(1, "scum"), (3, "fine")], "doc_id long, text string")
    model = tox.train(frame, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert [r.predicted for r in tox.score(frame, model).collect()] == [0, 0]
    assert tox.drop_toxic(frame.withColumn("_id", frame.doc_id), model).count() == 2
