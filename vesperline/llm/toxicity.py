"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperline.llm._spark import as_table

_TOKENS = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")
_PREFIXES = range(2, 9)
_KNOWN_WORDS = 1 << 19
N_FEATURES = 4


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def parts_of(word: str) -> list[str]:
    """What a lower-case word is known by: its first letters, and the whole of it."""
    return [word[:n] for n in _PREFIXES if n < len(word)] + ["=" + word]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]  # log-odds of parts that speak for toxic text
    weights: np.ndarray = field(default_factory=lambda: np.array([-6.0, 2.0, 0.0, 0.0]))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-20.0, 0.0, 0.0, 0.0]))

    def features(self, word: str) -> tuple[float, float, float, float] | None:
        """(1, strongest part, longest part, number of parts) or None where the lexicon has no part of the word."""
        found = [(self.lexicon[p], len(p)) for p in parts_of(word) if p in self.lexicon]
        return (1.0, max(found)[0], max(n for _, n in found) / 8, len(found) / 8) if found else None


def marginals(emission: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for each token of one sentence. ``emission``: its score against the clean state."""
    m = np.exp(moves)
    n = len(emission)
    up = np.exp(np.clip(emission, -50, 50)).tolist()
    (m00, m01), (m10, m11) = m.tolist()
    forward, backward = [0.0] * n, [0.0] * n
    a = 1.0  # odds of the state before, times what it weighs; the start weighs both states alike
    for t in range(n):
        a = up[t] * ((m01 + m11 * a) / (m00 + m10 * a) if t else 1.0)
        forward[t] = a
    b = 1.0
    for t in range(n - 1, -1, -1):
        backward[t] = b
        x = up[t] * b
        b = (m10 + m11 * x) / (m00 + m01 * x)
    odds = np.array(forward) * np.array(backward)
    return odds / (1 + odds)


class Scorer:
    """Sums and maxima of marginals for whole texts; a sentence without a known part depends on its length alone."""

    def __init__(self, model: Model):
        self.model = model
        self.base = float(model.weights[0])
        self._known: dict[str, float] = {}
        self._plain: dict[int, tuple[float, float]] = {0: (0.0, 0.0)}

    def emission(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            if word in _ENDS:
                found = math.nan
            else:
                x = self.model.features(word)
                found = float(np.dot(x, self.model.weights)) if x else self.base
            if len(self._known) > _KNOWN_WORDS:
                self._known = {}
            self._known[word] = found
        return found

    def plain(self, n: int) -> tuple[float, float]:
        if n not in self._plain:
            p = marginals(np.full(n, self.base), self.model.moves)
            if len(self._plain) > 1 << 12:
                self._plain = {0: (0.0, 0.0)}
            self._plain[n] = float(p.sum()), float(p.max())
        return self._plain[n]

    def text(self, text: str, offsets: bool = False) -> tuple[float, float, int, list[tuple[int, int, float]]]:
        """(sum of marginals, greatest marginal, words, words likelier toxic than not as (start, end, marginal))."""
        words = _TOKENS.findall(text.lower())
        scores = np.fromiter(map(self.emission, words), np.float64, len(words))
        stops = np.flatnonzero(np.isnan(scores))
        begins, ends = np.concatenate(([0], stops + 1)), np.concatenate((stops, [len(scores)]))
        notable = np.flatnonzero(~np.isnan(scores) & (scores != self.base))
        marked = np.zeros(len(begins), bool)
        marked[np.searchsorted(stops, notable)] = True
        total = top = 0.0
        for n, k in Counter((ends - begins)[~marked].tolist()).items():
            s, m = self.plain(n)
            total, top = total + k * s, max(top, m)
        spans = []
        for i in np.flatnonzero(marked).tolist():
            p = marginals(scores[begins[i] : ends[i]], self.model.moves)
            total, top = total + float(p.sum()), max(top, float(p.max()))
            if offsets:
                spans += [(int(begins[i] + j), float(p[j])) for j in np.flatnonzero(p >= 0.5).tolist()]
        if not spans:
            return total, top, len(words) - len(stops), []
        wanted = dict(spans)
        places = [m.span() for m in _TOKENS.finditer(text)]
        if len(places) != len(words):  # lower-casing made other words
            places = [m.span() for m in _TOKENS.finditer("".join(c.lower() if len(c.lower()) == 1 else c for c in text))]
        return total, top, len(words) - len(stops), [(*places[t], p) for t, p in wanted.items() if t < len(places)]


def document_features(total: float, top: float, words: int) -> tuple[float, float, float, float]:
    """What a document's marginals come to: how many words are toxic, how surely one is, and how dense they are."""
    return 1.0, math.log1p(total), top, math.log1p(100 * total / max(words, 1))


def calibrated(model: Model, total: float, top: float, words: int) -> float:
    z = float(np.dot(document_features(total, top, words), model.calibration))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _texts(batch: pa.RecordBatch, at: int) -> list[str]:
    return [t or "" for t in batch.column(at).to_pylist()]


def _sketch(text: str, seeds: tuple[int, ...]) -> list[int]:
    """A minimum of hashed three-word runs for each seed; near copies share most of them."""
    words = text.lower().encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    return [min(xxhash.xxh64_intdigest(r, s) for r in runs) >> 1 for s in seeds]


def without_copies(sample: DataFrame, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``sample`` with one document of most groups of near copies, else a copied document's every word would look as
    toxic as the document."""
    names = [f"k{s}" for s in seeds]

    def run(batches):
        for batch in batches:
            rows = [_sketch(t, seeds) for t in _texts(batch, 1)]
            keys = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(seeds))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *keys], ["_id", *names])

    keys = as_table(sample.select("_id", "_text").mapInArrow(run, ", ".join(f"{n} long" for n in ["_id", *names])))
    for name in names:
        keys = keys.join(keys.groupBy(name).agg(F.min("_id").alias("_id")).select("_id"), "_id", "left_semi")
    return sample.join(keys.select("_id").distinct(), "_id", "left_semi")


def _part_counts(sample: DataFrame) -> DataFrame:
    """(part, toxic, clean): documents of each kind that hold each part; counted in tasks before the shuffle."""

    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                words = set(_TOKENS.findall(text.lower())) - _ENDS
                (toxic if label else clean).update({p for w in words for p in parts_of(w)})
        parts = list(toxic | clean)
        for at in range(0, len(parts), 1 << 16):
            some = parts[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[p] for p in some], pa.int64()) for c in (toxic, clean))], ["part", "toxic", "clean"])

    counts = sample.select("toxic", "_text").mapInArrow(run, "part string, toxic long, clean long")
    return counts.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, least_documents: int = 5, least_log_odds: float = 3.0) -> dict[str, float]:
    """Parts that many toxic documents and hardly any clean ones hold. The sample's bound is the lexicon's bound."""
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    found = _part_counts(sample).where(F.col("toxic") >= least_documents).select("part", odds.alias("odds")).where(F.col("odds") >= least_log_odds)
    return {r.part: r.odds for r in found.collect()}


def _training_sentences(sample: DataFrame, model: Model, most: int, longest: int = 60) -> list[tuple[bool, np.ndarray, float]]:
    """Sentences as token features, each with its label and how often it occurs: tokens that the lexicon knows are toxic
    in toxic documents and clean in clean ones. Sentences without such a token are all of them counted by their length;
    one of over ``longest`` tokens is read in parts. Of the different sentences about ``most`` are used, by a hash."""

    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                sentence: list[tuple] = []
                for word in [*_TOKENS.findall(text.lower()), "."]:
                    if word not in _ENDS:
                        sentence.append(model.features(word) or _UNKNOWN)
                        if len(sentence) < longest:
                            continue
                    if sentence:
                        found[bool(label), np.array(sentence, np.float32).tobytes()] += 1
                    sentence = []
        columns = list(zip(*((label, x, n) for (label, x), n in found.items()))) or [()] * 3
        kinds = (pa.bool_(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["label", "x", "n"])

    rows = sample.select("toxic", "_text").mapInArrow(run, "label boolean, x binary, n long").groupBy("label", "x").agg(F.sum("n").alias("n"))
    rows = rows.orderBy(F.xxhash64("x"), "label").limit(most).collect()
    return [(r.label, np.frombuffer(r.x, np.float32).astype(np.float64).reshape(-1, N_FEATURES), float(r.n)) for r in rows]


_UNKNOWN = (1.0, 0.0, 0.0, 0.0)  # features of a word without a part in the lexicon


def fit_field(sentences: list[tuple[bool, np.ndarray, float]], start: Model, steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves by gradient ascent on the conditional log-likelihood, all sentences ``(label, features, how
    often)`` at once."""
    weights, moves = start.weights.copy(), start.moves.copy()
    if not sentences:
        return weights, moves
    size = np.array([len(x) for _, x, _ in sentences])
    often = np.array([n for _, _, n in sentences])
    often = often / often.sum()
    X = np.zeros((len(size), size.max(), N_FEATURES))
    for i, (_, x, _) in enumerate(sentences):
        X[i, : len(x)] = x
    on = np.arange(size.max()) < size[:, None]
    Y = np.array([label for label, _, _ in sentences])[:, None] & (X[:, :, 1] > 0) & on
    y = Y.astype(int)
    pair_on = on[:, 1:]
    seen_pairs = np.array([[often @ np.sum(pair_on & (y[:, :-1] == a) & (y[:, 1:] == b), axis=1) for b in (0, 1)] for a in (0, 1)], float)
    momentum, square = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for step in range(1, steps + 1):
        # odds of the toxic state: forward with a token's own score, backward without it
        up, m = np.exp(np.clip(X @ weights, -50, 50)), np.exp(moves)
        ahead, back = np.empty_like(up), np.ones_like(up)
        ahead[:, 0] = up[:, 0]
        for t in range(1, on.shape[1]):
            ahead[:, t] = up[:, t] * (m[0, 1] + m[1, 1] * ahead[:, t - 1]) / (m[0, 0] + m[1, 0] * ahead[:, t - 1])
        for t in range(on.shape[1] - 2, -1, -1):
            x = up[:, t + 1] * back[:, t + 1]
            back[:, t] = np.where(on[:, t + 1], (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x), 1.0)
        odds = ahead * back
        p = np.where(on, odds / (1 + odds), 0.0)
        grad_w = np.einsum("nt,ntf->f", (Y - p) * often[:, None], X)
        before, after = ahead[:, :-1], up[:, 1:] * back[:, 1:]
        joint = [[m[0, 0], m[0, 1] * after], [m[1, 0] * before, m[1, 1] * before * after]]
        each = np.where(pair_on, often[:, None], 0.0) / (joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1])
        grad_m = seen_pairs - np.array([[np.sum(each * joint[i][j]) for j in (0, 1)] for i in (0, 1)])
        grad = np.concatenate((grad_w, grad_m.ravel())) - decay * np.concatenate((weights, moves.ravel()))
        momentum = 0.9 * momentum + 0.1 * grad
        square = 0.99 * square + 0.01 * grad**2
        move = rate * (momentum / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, moves = weights + move[:N_FEATURES], moves + move[N_FEATURES:].reshape(2, 2)
    return weights, moves


def fit_calibration(x: np.ndarray, y: np.ndarray, decay: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        penalty = decay * np.array([0.0, *[1.0] * (len(w) - 1)])
        move = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty + 1e-9), x.T @ (y - p) - penalty * w)
        w = w + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, most_sentences: int = 20_000) -> Model:
    """A model from labelled rows that are not held out. About ``most_rows`` of them are used, chosen by a hash of the
    id, and of their different sentences (as token features) about ``most_sentences``: this bounds what the driver gets. Most
    near copies among the rows are left out of the fit, and sentences of over 60 tokens are read in parts there. Null labels and ids are left out; without both labels the model scores 0."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    share = min(1.0, most_rows / max(1, rows.count()))
    rows = rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sample = as_table(without_copies(as_table(source.join(rows, "_id").select("_id", "toxic", "_text"))))
    n = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model({})
    model = Model(learn_lexicon(sample, n[1], n[0]))
    weights, moves = fit_field(_training_sentences(sample, model, most_sentences), model)
    model = Model(model.lexicon, weights, moves)

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            sums = [scorer.text(t)[:3] for t in _texts(batch, 1)]
            columns = list(zip(*sums)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns)], ["toxic", "total", "top", "words"])

    got = sample.select("toxic", "_text").mapInArrow(run, "toxic int, total double, top double, words double").orderBy("toxic", "total", "top", "words").collect()
    x = np.array([document_features(r.total, r.top, r.words) for r in got])
    return Model(model.lexicon, weights, moves, fit_calibration(x, np.array([r.toxic for r in got], float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``(id, score, predicted, spans)`` for every text; ``spans`` are the offending words with their marginals.

    Only the text is read. A null text is empty; an empty text has the score of no toxic words; an empty table gives
    no rows.
    """

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            found = [scorer.text(t, offsets=True) for t in _texts(batch, 1)]
            scores = [calibrated(model, *f[:3]) for f in found]
            spans = [[dict(start=s, end=e, marginal=p) for s, e, p in f[3]] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, kind)], ["_id", "score", "predicted", "spans"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = "_id long, score double, predicted int, spans array<struct<start:int,end:int,marginal:double>>"
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more, in one pass over them."""

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            keep = [calibrated(model, *scorer.text(t)[:3]) < threshold for t in _texts(batch, at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
