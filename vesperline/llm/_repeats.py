"""Exact search for repeated windows of ``length`` units (bytes or words) over a whole corpus.

Prefix-free parsing. A rolling hash of ``width`` units marks triggers: the trigger of a window is its least gram, the
first of equal ones. It depends on the window's own units alone, so equal windows have equal triggers at equal places,
and the windows of one trigger are a run. That run's text, from its first window's start to its last window's end, is
a phrase: phrases overlap by ``length - 1`` units and every window lies in one of them.

1. Phrases that are equal form a word of the dictionary; all windows of a later occurrence repeat an earlier one.
2. Words of the dictionary that share a trigger may still share some windows, at the edge of a repeated passage. The
   texts of the words of one trigger meet in one bucket and are compared window by window. A trigger with very many
   words (the edge of a passage that a great part of all documents hold) would fill a bucket: the windows of its words
   are dealt by their own hashes instead.

Each task resolves what repeats among its own rows first and sends one row on for each distinct phrase or window, so
a passage that a third of all documents hold costs a bucket one row for each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperline.llm._spark import as_table

_LOW = np.uint64(0xFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15  # odd
#: What a task holds at once in forms that take many times its size; a task or a bucket of any size goes in such parts.
_UNITS_AT_ONCE = 1 << 18
_PHRASES_AT_ONCE = 1 << 18
_TEXTS_AT_ONCE = 1 << 20

REPEATED, BY_TRIGGER, BY_WINDOW = 0, 1, 2
SPANS = pa.schema([("_id", pa.int64()), ("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()), ("gram", pa.int64())])
_BLOB_COLUMNS = "bucket int, data binary"
_SPAN_COLUMNS = "_id long, kind byte, start long, end long, gram long"
BLOBS = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


class Units(NamedTuple):
    """A text as units: a 64-bit value for each, the bytes they are compared by, and where each begins and ends there."""

    values: np.ndarray
    data: bytes
    begins: np.ndarray | None  # None: unit i is byte i
    ends: np.ndarray | None

    def cut(self, start: int, end: int) -> bytes:
        if self.begins is None:
            return self.data[start:end]
        return self.data[self.begins[start] : self.ends[end - 1]]


class Config(NamedTuple):
    length: int
    width: int
    units: Callable[[str | bytes | None], Units]
    crowd: int = 512  # words of one trigger; beyond, their windows are dealt one by one


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    return mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, by doubling."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    total, done, part, size = None, 0, values, 1
    while True:
        if width & size:
            if total is None:
                total, done = part, size
            else:
                total = total[: len(values) - done - size + 1] * power(size) + part[done : len(values) - size + 1]
                done += size
        size *= 2
        if size > width:
            return total
        part = part[: len(part) - size // 2] * power(size // 2) + part[size // 2 :]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[: len(values) - (width - size)], values[width - size :])
    return values


def trigger_runs(values: np.ndarray, piece: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each run that shares a trigger, and the trigger's gram. Windows lie in one piece."""
    if len(values) < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    grams = mixed(rolling(values, width))
    least = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - width + 1)
    at = (least & _LOW).astype(np.int64)
    valid = piece[: len(at)] == piece[length - 1 :]
    turn = at[1:] != at[:-1]
    first = np.flatnonzero(valid & np.concatenate(([True], turn | ~valid[:-1])))
    last = np.flatnonzero(valid & np.concatenate((turn | ~valid[1:], [True])))
    return first, last, grams[at[first]]


class Phrases(NamedTuple):
    gram: np.ndarray  # uint32, of the trigger
    code: np.ndarray  # uint64, of the phrase's text
    doc: np.ndarray
    start: np.ndarray  # uint32: first window
    size: np.ndarray  # uint32: windows

    def take(self, index) -> Phrases:
        return Phrases(*(x[index] for x in self))

    @staticmethod
    def concat(parts: list[Phrases]) -> Phrases:
        return Phrases(*(np.concatenate(x) for x in zip(*parts)))

    def pack(self) -> bytes:
        """Columns one after another, ids by halves: their high halves are mostly equal and compress away."""
        doc = self.doc.view(np.uint64)
        halves = (doc & _LOW).astype(np.uint32), (doc >> np.uint64(32)).astype(np.uint32)
        return b"".join(x.tobytes() for x in (self.gram, self.code, *halves, self.start, self.size))

    @staticmethod
    def unpack(data: bytes) -> Phrases:
        n = len(data) // 28
        at = np.cumsum([0, 4, 8, 4, 4, 4]) * n
        gram, low, high, start, size = (np.frombuffer(data, np.uint32, n, at[i]) for i in (0, 2, 3, 4, 5))
        doc = (low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)).view(np.int64)
        return Phrases(gram, np.frombuffer(data[at[1] : at[2]], np.uint64), doc, start, size)


def _pieces(batch: pa.RecordBatch, config: Config) -> Iterator[list[tuple[int, Units, int, int]]]:
    """(doc, units, first, past the last unit) by lists of about _UNITS_AT_ONCE units; long texts in overlapping pieces."""
    held, total = [], 0
    step = _UNITS_AT_ONCE
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        units = config.units(text.as_py())
        n = len(units.values)
        for at in range(0, max(1, n - config.length + 1), step):
            if n - at < config.length:
                break
            held.append((doc, units, at, min(n, at + step + config.length - 1)))
            total += held[-1][3] - at
            if total >= step:
                yield held
                held, total = [], 0
    if held:
        yield held


def _phrases(held: list[tuple[int, Units, int, int]], config: Config) -> Phrases:
    sizes = np.array([end - at for _, _, at, end in held])
    values = np.concatenate([u.values[at:end] for _, u, at, end in held])
    piece = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
    first, last, gram = trigger_runs(values, piece, config.length, config.width)
    owner = piece[first]
    shift = (np.array([at for _, _, at, _ in held]) - (np.cumsum(sizes) - sizes))[owner]
    start, end = first + shift, last + shift + config.length
    digest = xxhash.xxh3_64_intdigest
    cuts = np.searchsorted(owner, np.arange(len(held) + 1))
    code: list[int] = []
    for k, (_, units, _, _) in enumerate(held):
        s, e = start[cuts[k] : cuts[k + 1]], end[cuts[k] : cuts[k + 1]]
        if units.begins is not None:
            s, e = units.begins[s], units.ends[e - 1]
        data = units.data
        code += [digest(data[i:j]) for i, j in zip(s.tolist(), e.tolist())]
    doc = np.array([h[0] for h in held], np.int64)[owner]
    return Phrases((gram & _LOW).astype(np.uint32), np.array(code, np.uint64), doc, start.astype(np.uint32), (last - first + 1).astype(np.uint32))


def firsts(p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the phrases that are the first with their text, and of those that repeat one.

    A phrase at the same place of the same document as the first is that phrase again (a repeated row): it is neither.
    """
    order = np.argsort(p.code, kind="stable")
    code, gram, size = p.code[order], p.gram[order], p.size[order]
    tied = np.flatnonzero((code[1:] == code[:-1]))
    inside = np.zeros(len(order), bool)
    inside[tied] = inside[tied + 1] = True
    alone, some = order[~inside], order[inside]
    some = some[np.lexsort((p.start[some], p.doc[some], p.size[some], p.gram[some], p.code[some]))]
    x = p.take(some)
    new = np.concatenate(([True], (x.code[1:] != x.code[:-1]) | (x.gram[1:] != x.gram[:-1]) | (x.size[1:] != x.size[:-1])))[: len(some)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))
    again = (x.doc == x.doc[head]) & (x.start == x.start[head])
    return np.concatenate((alone, some[new])), some[~again]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans that touch or overlap, for each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    turn = np.concatenate(([True], doc[1:] != doc[:-1]))
    rank = np.cumsum(turn)
    high = int(end.max()) + 1
    reach = np.maximum.accumulate(end + rank * high) - rank * high
    new = turn | np.concatenate(([True], start[1:] > reach[:-1]))
    cut = np.flatnonzero(new)
    return doc[cut], start[cut], np.maximum.reduceat(end, cut)


def _spans(doc, kind, start, end, gram=None) -> pa.RecordBatch:
    n = len(doc)
    whole = [np.asarray(x).astype(np.int64) for x in (start, end, np.zeros(n) if gram is None else gram)]
    kinds = np.broadcast_to(np.asarray(kind, np.int8), n)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(kinds), *map(pa.array, whole)], schema=SPANS)


_PHRASES, _FINISHED, _TEXTS = b"\0", b"\1", b"\2"  # what a blob holds


def _dealt(p: Phrases, buckets: int, salt: np.ndarray, local: tuple) -> list[tuple[int, bytes]]:
    """A blob of phrases for each bucket, and blobs of spans that are finished."""
    bucket = (salt % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    blobs = [(b, _PHRASES + p.take(order[cuts[b] : cuts[b + 1]]).pack()) for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()]
    for at in range(0, len(local[0]), 1 << 12):
        data = b"".join(x[at : at + (1 << 12)].astype(np.int64).tobytes() for x in local)
        blobs.append((xxhash.xxh32_intdigest(data) % buckets, _FINISHED + data))
    return blobs


def _blob_batch(blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    names, data = zip(*blobs) if blobs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], schema=BLOBS)


def _flush(parts: list[Phrases], buckets: int, reach: int) -> pa.RecordBatch:
    p = Phrases.concat(parts)
    keep, again = firsts(p)
    x = p.take(again)
    local = merged(x.doc, x.start, x.start + x.size + np.uint32(reach))
    p = p.take(keep)
    return _blob_batch(_dealt(p, buckets, mixed(p.gram.astype(np.uint64) + np.uint64(1)), local))


def _map_phrases(config: Config, buckets: int):
    def run(batches):
        parts, total = [], 0
        for batch in batches:
            for held in _pieces(batch, config):
                parts.append(_phrases(held, config))
                total += len(parts[-1].doc)
                if total >= _PHRASES_AT_ONCE:
                    yield _flush(parts, buckets, config.length - 1)
                    parts, total = [], 0
        if parts:
            yield _flush(parts, buckets, config.length - 1)

    return run


class Words(NamedTuple):
    """Texts of words of the dictionary, each with the place of its first occurrence."""

    doc: list[int]
    start: list[int]
    units: list[Units]


def together(key: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """Indices in lists whose sizes add up to about ``most``; what shares a key is in one list."""
    if not len(key):
        return []
    order = np.argsort(key, kind="stable")
    key, size = key[order], size[order].astype(np.int64)
    turn = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    before = (np.cumsum(size) - size)[turn]
    return np.split(order, turn[np.unique(before // most, return_index=True)[1]][1:])


def _packed_texts(texts: list[tuple[int, int, int, bytes]]) -> bytes:
    """(gram, document, start, text) of words, the numbers as columns before the texts."""
    gram, doc, start, data = zip(*texts)
    heads = np.array(gram, np.uint32), np.array(doc, np.int64), np.array(start, np.int64), np.array([len(x) for x in data], np.uint32)
    return b"".join((len(data).to_bytes(4, "little"), *(x.tobytes() for x in heads), *data))


def _words_of(blobs: list[bytes], config: Config) -> Iterator[Words]:
    """The words of a bucket's blobs by lists of about _TEXTS_AT_ONCE bytes. Equal windows have equal triggers, so the
    words that may share one are in one list."""
    heads = []
    for k, blob in enumerate(blobs):
        n = int.from_bytes(blob[1:5], "little")
        (gram, size), (doc, start) = ([np.frombuffer(blob, kind, n, 5 + at * n) for at in places] for kind, places in ((np.uint32, (0, 20)), (np.int64, (4, 12))))
        heads.append((gram, doc, start, np.full(n, k), 5 + 24 * n + np.cumsum(size, dtype=np.int64) - size, size))
    gram, doc, start, blob, at, size = (np.concatenate(x) for x in zip(*heads))
    for some in together(gram, size, _TEXTS_AT_ONCE):
        places = zip(blob[some].tolist(), at[some].tolist(), size[some].tolist())
        yield Words(doc[some].tolist(), start[some].tolist(), [config.units(blobs[b][i : i + n]) for b, i, n in places])


class Windows(NamedTuple):
    """All windows of some words of the dictionary, in order: their word, their place in it, their rolling hash."""

    owner: np.ndarray
    inside: np.ndarray
    hash: np.ndarray

    @staticmethod
    def of(words: Words, length: int) -> Windows:
        sizes = np.array([len(u.values) for u in words.units])
        count = sizes - length + 1
        owner = np.repeat(np.arange(len(sizes)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        rolled = rolling(np.concatenate([u.values for u in words.units]), length)
        return Windows(owner, inside, rolled[(np.cumsum(sizes) - sizes)[owner] + inside])

    def recurring(self) -> np.ndarray:
        """Whether another of these windows has the hash. Equal windows always do; what follows compares their units."""
        _, group, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        return count[group] > 1


def recurring_words(words: Words, config: Config) -> tuple[Words, Windows, np.ndarray]:
    """The words that hold a recurring window, their windows, and which of those recur."""
    windows = Windows.of(words, config.length)
    again = windows.recurring()
    kept = np.unique(windows.owner[again])
    some = Words(*([part[i] for i in kept.tolist()] for part in words))
    inside = np.isin(windows.owner, kept)
    return some, Windows(np.searchsorted(kept, windows.owner[inside]), windows.inside[inside], windows.hash[inside]), again[inside]


def first_windows(code: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows with class numbers: indices of each class's first, and of those that repeat one at another place."""
    order = np.lexsort((start, doc, code))
    code, d, s = code[order], doc[order], start[order]
    new = np.concatenate(([True], code[1:] != code[:-1]))[: len(order)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[new], order[~new & ~((d == d[head]) & (s == s[head]))]


def _phrase_spans(p: Phrases, config: Config) -> Iterator[pa.RecordBatch]:
    """Spans of the phrases that repeat, then of those that share their trigger with other words of the dictionary."""
    reach = np.uint32(config.length - 1)
    kept = []
    for some in together(p.code, np.ones(len(p.code)), _PHRASES_AT_ONCE):
        part = p.take(some)
        keep, again = firsts(part)
        x = part.take(again)
        doc, start, end = merged(x.doc, x.start, x.start + x.size + reach)
        yield _spans(doc, REPEATED, start, end)
        kept.append(some[keep])
    order = np.concatenate(kept)
    order = order[np.argsort(p.gram[order], kind="stable")]
    gram = p.gram[order]
    cut = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    size = np.diff(np.concatenate((cut, [len(gram)])))
    n = np.repeat(size, size)
    order, n = order[n > 1], n[n > 1]
    for at in range(0, len(order), _PHRASES_AT_ONCE):
        x = p.take(order[at : at + _PHRASES_AT_ONCE])
        kind = np.where(n[at : at + _PHRASES_AT_ONCE] > config.crowd, BY_WINDOW, BY_TRIGGER)
        yield _spans(x.doc, kind, x.start, x.start + x.size + reach, x.gram)


def _reduce(config: Config, classes):
    """The rows of a bucket: spans that repeat, and the words of the dictionary that share a trigger."""

    def run(table: pa.Table) -> pa.Table:
        out, parts, texts = [], [], []
        for blob in table["data"]:
            data = blob.as_py()
            if data[:1] == _FINISHED:
                doc, start, end = np.frombuffer(data, np.int64, offset=1).reshape(3, -1)
                out.append(_spans(doc, REPEATED, start, end))
            elif data[:1] == _TEXTS:
                texts.append(data)
            else:
                parts.append(Phrases.unpack(data[1:]))
        if texts:
            for words in _words_of(texts, config):
                code, doc, start = classes(words, config)
                again = first_windows(code, doc, start)[1]
                doc, start, end = merged(doc[again], start[again], start[again] + config.length)
                out.append(_spans(doc, REPEATED, start, end))
            texts.clear()
        if parts:
            p = Phrases.concat(parts)
            parts.clear()
            out += _phrase_spans(p, config)
        return pa.Table.from_batches(out, schema=SPANS)

    return run


def bucket_count(df: DataFrame) -> int:
    """Buckets by the size of the input as Spark's planner knows it: about 16 MB of input each, 256 at least. Where the
    planner does not know it (it then answers with the largest number there is), the texts are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = df.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    return max(256, min(size >> 24, 1 << 20))


def _map_words(config: Config, buckets: int):
    """Texts of words to the bucket of their trigger; for those of a crowded trigger, windows to the bucket of their hash."""
    digest = xxhash.xxh3_128_intdigest

    def windows(words: Words) -> list[tuple[int, bytes]]:
        every = Windows.of(words, config.length)
        doc, start = np.array(words.doc, np.int64)[every.owner], np.array(words.start, np.int64)[every.owner] + every.inside
        texts = [digest(words.units[o].cut(i, i + config.length)) for o, i in zip(every.owner.tolist(), every.inside.tolist())]
        low = np.array([c & 0xFFFFFFFFFFFFFFFF for c in texts], np.uint64)
        high = np.array([c >> 96 for c in texts], np.uint64).astype(np.uint32)
        # the gram column holds more of the hash here; no two windows with equal hashes are then left to compare
        p = Phrases(high, low, doc, start.astype(np.uint32), np.ones(len(doc), np.uint32))
        keep, again = firsts(p)
        local = merged(doc[again], start[again], start[again] + config.length)
        return _dealt(p.take(keep), buckets, mixed(low[keep]), local)

    def flush(texts: dict[int, list[tuple]], words: Words) -> pa.RecordBatch:
        blobs = [(b, _TEXTS + _packed_texts(t)) for b, t in texts.items()]
        return _blob_batch(blobs + (windows(words) if words.doc else []))

    def run(batches):
        texts, words, total = {}, Words([], [], []), 0
        for batch in batches:
            for doc, text, asked in zip(*(batch.column(i) for i in range(3))):
                units, doc = config.units(text.as_py()), doc.as_py()
                columns = [asked.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
                bucket = mixed(columns[3].astype(np.uint64) + np.uint64(1)) % np.uint64(buckets)
                for kind, start, end, gram, b in zip(*(c.tolist() for c in (*columns, bucket))):
                    data = units.cut(start, end)
                    if kind == BY_TRIGGER:
                        texts.setdefault(b, []).append((gram, doc, start, data))
                    else:
                        words.doc.append(doc)
                        words.start.append(start)
                        words.units.append(config.units(data))
                    total += end - start
                    if total >= _TEXTS_AT_ONCE:
                        yield flush(texts, words)
                        texts, words, total = {}, Words([], [], []), 0
        if total:
            yield flush(texts, words)

    return run


def _resolved(blobs: DataFrame, config: Config, classes) -> DataFrame:
    return blobs.groupBy("bucket").applyInArrow(_reduce(config, classes), _SPAN_COLUMNS)


def repeated_spans(docs: DataFrame, config: Config, classes) -> DataFrame:
    """``docs(_id, _text)``, ids not null -> ``(_id, spans)``: for each document with any, packed spans
    ``start << 32 | end`` of units covered by a window that also starts earlier. They may overlap.

    ``classes(words, config)`` gives class number, document and start of every window of the words given that equals
    another of them.
    """
    buckets = bucket_count(docs)
    found = as_table(_resolved(docs.mapInArrow(_map_phrases(config, buckets), _BLOB_COLUMNS), config, classes))
    words = found.where(F.col("kind") != REPEATED).groupBy("_id").agg(F.collect_list(F.struct("kind", "start", "end", "gram")).alias("asked"))
    texts = docs.join(words, "_id").select("_id", "_text", "asked").mapInArrow(_map_words(config, buckets), _BLOB_COLUMNS)
    edges = _resolved(texts, config, classes).where(F.col("kind") == REPEATED)
    every = found.where(F.col("kind") == REPEATED).unionByName(edges)
    packed = (F.shiftleft("start", 32) + F.col("end")).alias("span")
    return every.groupBy("_id").agg(F.collect_list(packed).alias("spans"))


def with_spans(docs: DataFrame, config: Config, classes, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """``(_id, _text, spans, rest)`` for every row, ``rest`` holding the columns of ``carry``; rows without an id take
    no part and have no spans."""
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), rest.alias("rest"))
    known = source.where("_id is not null")
    joined = known.join(repeated_spans(known.select("_id", "_text"), config, classes), "_id", "left")
    alone = source.where("_id is null").withColumn("spans", F.lit(None).cast("array<bigint>"))
    return joined.select("_id", "_text", "spans", "rest").unionByName(alone)


def runs_of(spans: pa.Scalar) -> list[tuple[int, int]]:
    """Maximal runs of a document's packed spans."""
    if not spans.is_valid:
        return []
    flat = spans.values.to_numpy(zero_copy_only=False)
    _, start, end = merged(np.zeros(len(flat), np.int64), flat >> 32, flat & 0xFFFFFFFF)
    return list(zip(start.tolist(), end.tolist()))
