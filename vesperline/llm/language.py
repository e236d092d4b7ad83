"""Language identification by rank-order profiles: the most frequent n-grams of a text against those of each language."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
_BITS = 21  # of a code point
_MOST_LANGUAGES = 4096
_CHARS_AT_ONCE = 1 << 22

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """What each code point is: 2 for letters, 1 for marks that stand with letters, 0 for the rest."""
    if not _tables:
        import unicodedata

        kinds = {"L": 2, "M": 1}
        _tables.append(np.fromiter((kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.int8, 0x110000))
    return _tables[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(codes in order, how often each, whether the text has a letter) of all runs of one to three characters.

    Texts are in lower case; what is no letter is a blank, many of them are one, and one stands at either end. A code
    holds up to three code points, 21 bits each, the first one highest. All are counted from one sort: runs of one and
    two characters are what the runs of three begin with.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = _letters()[codes]
    if not (kind == 2).any():
        return np.empty(0, np.int64), np.empty(0, np.int64), False
    codes = np.concatenate(([32], np.where(kind > 0, codes, 32), [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    after = np.concatenate((codes, [0, 0]))
    three = np.sort((codes << 2 * _BITS) | (after[1:-1] << _BITS) | after[2:])
    found, counts = [], []
    for bits in (0, _BITS, 2 * _BITS):
        short = three >> bits
        at = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        keys, n = short[at] << bits, np.diff(at, append=len(short))
        whole = (keys >> bits) & ((1 << _BITS) - 1) != 0  # runs that go past the end are none
        found.append(keys[whole])
        counts.append(n[whole])
    keys, n = np.concatenate(found), np.concatenate(counts)
    by = np.argsort(keys, kind="stable")
    keys, n = keys[by], n[by]
    blank = keys == 32 << 2 * _BITS  # a blank alone says nothing
    return keys[~blank], n[~blank], True


def profile(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent codes, most frequent first; equal counts by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


class Profiles:
    """Rank-order profiles of languages; ``nearest`` gives the language of a text and how clear the choice is."""

    def __init__(self, ranked: dict[str, np.ndarray], size: int):
        self.size, self.names = size, sorted(ranked)
        self.codes = np.unique(np.concatenate([np.empty(0, np.int64), *ranked.values()]))
        #: The rank of each code in each language; the last row, and codes that a language lacks, are out of reach.
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, ranked[name]), k] = np.arange(len(ranked[name]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out of place: how far each of a text's codes stands from its place in a language; ``size`` where it has none."""
        at = np.searchsorted(self.codes, own)
        known = np.append(self.codes, -1)[at] == own
        ranks = self.ranks[np.where(known, at, len(self.codes))]
        return np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)

    def nearest(self, text: str | None) -> tuple[str, float]:
        codes, counts, lettered = grams(text or "")
        if not lettered or not self.names:
            return UNKNOWN, 0.0
        own = profile(codes, counts, self.size)
        d = self.distances(own)
        best = int(d.argmin())
        other = np.delete(d, best).min() if len(d) > 1 else self.size * len(own)
        return self.names[best], float((other - d[best]) / other) if other else 0.0


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def _counted(rows: DataFrame) -> DataFrame:
    """``rows(lang, text)`` -> ``(lang, code, n)``: counts of a task's texts by language, before any shuffle."""

    def run(batches: Iterable[pa.RecordBatch]):
        held: dict[str, list] = {}
        size = 0

        def sums():
            for lang, parts in held.items():
                codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield lang, codes, n

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes, n, _ = grams(text.as_py() or "")
                held.setdefault(lang, []).append((codes, n))
                size += len(codes)
            if size > _CHARS_AT_ONCE:
                held = {lang: [(codes, n)] for lang, codes, n in sums()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > _CHARS_AT_ONCE // 2:  # many languages or rare characters: send them on
                    yield from rows_of((lang, *p[0]) for lang, p in held.items())
                    held, size = {}, 0
        yield from rows_of(sums())

    def rows_of(found):
        for lang, codes, n in found:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 20_000, size: int = 400) -> Profiles:
    """Profiles of the ``size`` most frequent n-grams of each language, from rows that are not held out.

    Of each language about ``most_rows`` labelled rows are used, chosen by a hash of the id, with their whole texts; a
    language with fewer is learned from all of its rows. Null languages, texts and ids are left out. The profiles that
    reach the driver are as many numbers as languages times ``size``; over 4,096 languages are refused.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.select(F.col(id_col).cast("string").alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))
    sizes = labelled.groupBy("_lang").agg(F.count("*").alias("n")).limit(_MOST_LANGUAGES + 1).collect()
    if len(sizes) > _MOST_LANGUAGES:
        raise ValueError(f"more than {_MOST_LANGUAGES} languages")
    if not sizes:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r._lang, min(1 << 30, -(-most_rows * (1 << 30) // r.n)))])
    sample = labelled.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("_lang")))
    counts = _counted(sample.select("_lang", "_text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    top = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "place", "code").collect()
    ranked: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r.lang, r.place)):
        ranked.setdefault(r.lang, []).append(r.code)
    return Profiles({lang: np.array(codes, np.int64) for lang, codes in ranked.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every whole text: the language with the nearest profile.

    ``score`` is the gap to the next language's distance as a part of that distance, 0 to 1. A text that is null or has no letter is ``und`` with
    score 0, and so is every text where no language was learned; equal distances go to the first name. An empty table
    gives no rows; other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            found = [profiles.nearest(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, "_id long, lang_pred string, score double").withColumnRenamed("_id", id_col)
