"""SentencePiece encoding and decoding by suffix-array matching."""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = "▁"  # fixed value: the piece alphabet's space
_KNOWN = 1 << 20
_CHARS_AT_ONCE = 1 << 19
_NONE = np.int32(-1)


class Pieces:
    """A byte-fallback BPE vocabulary: the pieces, what they weigh, and the bytes each stands for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = np.array([model.get_score(i) for i in plain])
        self.ids = np.array(plain, np.int32)
        self.texts = [names[i] for i in plain]
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)  # equal scores: equal ranks
        self.longest = max(map(len, self.texts))
        self.one = {names[i]: i for i in plain if len(names[i]) == 1}
        self.byte_ids = [0] * 256
        self.bytes_of = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                value = int(names[i][3:5], 16)
                self.byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not model.is_control(i):
                self.bytes_of[i] = names[i].replace(_MARK, " ").encode()
        if any(_MARK in t.lstrip(_MARK) for t in self.texts) or any("\n" in t for t in self.texts):
            raise ValueError("a piece goes on past a space or a line end: segments would not be independent")
        #: Piece texts as rows of code points plus one, zero-filled: a row of a suffix compares like the text.
        self.rows = np.zeros((len(plain), self.longest), np.int64)
        for k, t in enumerate(self.texts):
            self.rows[k, : len(t)] = np.fromiter(map(ord, t), np.int64) + 1

    def fallback(self, char: str) -> list[int]:
        found = self.one.get(char)
        return [found] if found is not None else [self.byte_ids[b] for b in char.encode()]


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` values (shorter first), by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    size, order = 1, np.argsort(rank, kind="stable")
    while size < depth:
        after = np.zeros_like(rank)
        after[: max(0, len(rank) - size)] = rank[size:]
        pair = rank * (len(rank) + 2) + after
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        rank[order] = np.cumsum(np.concatenate(([True], sorted_pair[1:] != sorted_pair[:-1])))
        size *= 2
    return order


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row (a piece, zero-filled) the range of the suffix array that begins with it: one binary search for
    all pieces at a time."""
    padded = np.concatenate((codes.astype(np.int64) + 1, np.zeros(rows.shape[1], np.int64)))
    length = (rows > 0).sum(1)
    column = np.arange(rows.shape[1])

    def search(past: bool) -> np.ndarray:
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(order))
        while (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(order) - 1)
            text = padded[order[mid][:, None] + column] * (column < length[:, None])
            differs = text != rows
            at = differs.argmax(1)
            k = np.arange(len(rows))
            less = np.where(differs[k, at], text[k, at] < rows[k, at], past)
            going = lo < hi
            lo = np.where(going & less, mid + 1, lo)
            hi = np.where(going & ~less, mid, hi)
        return lo

    return search(False), search(True)


def edges(codes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of every piece: (position, length, piece), by position and then length."""
    order = suffix_array(codes, pieces.longest)
    first, past = occurrence_ranges(codes, order, pieces.rows)
    count = past - first
    piece = np.repeat(np.arange(len(count)), count)
    place = order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + first[piece]]
    length = (pieces.rows > 0).sum(1)[piece]
    by = np.argsort(place * (pieces.longest + 1) + length, kind="stable")
    return place[by], length[by], piece[by]


def relax_long(segments: list[str], pieces: Pieces) -> list[bytes]:
    """:func:`relax` of long segments: open edges wait in a heap by score and place, so each join costs a logarithm, and
    edges are looked up in their sorted list."""
    text = "\n".join(segments)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place, length, piece = edges(codes, pieces)
    width, n = pieces.longest + 1, len(codes)
    keys, found = array("q", (place * width + length).tobytes()), piece.tolist()
    rank = pieces.rank.tolist()

    def edge(start: int, end: int) -> int:
        if end - start >= width:
            return _NONE
        key = start * width + end - start
        at = bisect_left(keys, key)
        return found[at] if at < len(keys) and keys[at] == key else _NONE

    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts here; 0: none starts here
    heap: list[tuple[int, int, int]] = []

    def offer(start: int) -> None:
        if start >= 0 and end[start] < n and (joined := edge(start, end[end[start]])) >= 0:
            heappush(heap, (rank[joined], start, end[end[start]]))

    for start in range(n - 1):
        offer(start)
    while heap:
        _, start, stop = heappop(heap)
        middle = end[start]
        if not middle or middle == stop or middle >= n or end[middle] != stop:
            continue  # one of its symbols has joined another since
        end[start], end[middle] = stop, 0
        if stop < n:
            before[stop] = start
        offer(start)
        offer(before[start])
    out: list[list[int]] = [[]]
    at = 0
    while at < n:
        if text[at] == "\n":
            out.append([])
        else:
            whole = edge(at, end[at])
            out[-1] += [int(pieces.ids[whole])] if whole >= 0 else pieces.fallback(text[at])
        at = end[at]
    return [np.array(ids, "<u4").tobytes() for ids in out]


def relax(segments: list[str], pieces: Pieces) -> list[bytes]:
    """Ids (little-endian unsigned 32 bits) of each segment.

    The segments' characters are symbols. An edge that spans two neighbouring symbols lets them join; of a segment's
    open edges the best score, then the leftmost, is taken, until no edge is open: the vocabulary's own merge order.
    All segments advance together, one join each a round.
    """
    text = "\n".join(segments)  # no piece holds a line end, so no edge leaves its segment
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    place, length, piece = edges(codes, pieces)
    width = pieces.longest + 1
    table = np.full((len(codes), width), _NONE, np.int32)
    table[place, length] = piece
    owner = np.cumsum(codes == 10)
    start = np.flatnonzero(codes != 10)
    owner = owner[start]
    end = start + 1
    done_start, done_end = [], []
    while len(start) > 1:
        size = np.minimum(end[1:] - start[:-1], width)
        joined = np.where((owner[1:] == owner[:-1]) & (size < width), table[start[:-1], np.minimum(size, width - 1)], _NONE)
        open_at = np.flatnonzero(joined >= 0)
        if not len(open_at):
            break
        key = pieces.rank[joined[open_at]] * (len(codes) + 1) + open_at
        of = owner[open_at]
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        chosen = np.minimum.reduceat(key, cut) % (len(codes) + 1)
        end[chosen] = end[chosen + 1]
        keep = np.ones(len(start), bool)
        keep[chosen + 1] = False
        active = np.zeros(int(owner[-1]) + 1, bool)
        active[of] = True  # segments without an open edge are finished
        finished = keep & ~active[owner]
        done_start.append(start[finished])
        done_end.append(end[finished])
        keep &= ~finished
        start, end, owner = start[keep], end[keep], owner[keep]
    start, end = np.concatenate([*done_start, start]), np.concatenate([*done_end, end])
    by = np.argsort(start, kind="stable")
    start, end = start[by], end[by]
    found = table[start, end - start]
    ids = np.where(found >= 0, pieces.ids[found], -1)
    begins = np.concatenate(([0], np.flatnonzero(codes == 10) + 1, [len(codes) + 1]))
    cuts = np.searchsorted(start, begins)
    out, flat, chars = [], ids.tolist(), start.tolist()
    whole = ids.astype("<i4").tobytes()
    missing = np.concatenate(([0], np.cumsum(ids < 0)))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if missing[a] == missing[b]:
            out.append(whole[4 * a : 4 * b])
        else:
            spelled = [x for i, c in zip(flat[a:b], chars[a:b]) for x in ([i] if i >= 0 else pieces.fallback(text[c]))]
            out.append(np.array(spelled, "<u4").tobytes())
    return out


_LONG = 256  # characters, from which a segment is relaxed by itself
_SEGMENT = re.compile(f"{_MARK}*[^{_MARK}\n]+|\n|{_MARK}+")


class Codec:
    """Whole texts to ids and back. A segment (spaces and what follows them up to the next space or line end) is
    encoded once and kept; pieces never go past a segment."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self._known
        if len(known) > _KNOWN:
            known.clear()
        if "\n" not in known:
            known["\n"] = np.array(self.pieces.fallback("\n"), "<u4").tobytes()
        split = [_SEGMENT.findall(_MARK + t.replace(" ", _MARK)) if t else [] for t in texts]
        short, long = [], []
        for segment in {s for words in split for s in words if s not in known}:
            (long if len(segment) > _LONG else short).append(segment)
        for some, way in ((short, relax), (long, relax_long)):
            new, chars = [], 0
            for segment in some:
                new.append(segment)
                chars += len(segment)
                if chars >= _CHARS_AT_ONCE:
                    known.update(zip(new, way(new, self.pieces)))
                    new, chars = [], 0
            if new:
                known.update(zip(new, way(new, self.pieces)))
        return [b"".join([known[s] for s in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        bytes_of = self.pieces.bytes_of
        text = b"".join([bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text.removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``(id, n_tokens, ids_crc32, decoded_sha256, round_trip[, ids])`` for each whole text.

    ``round_trip``: decoding the ids gives the text back (it does unless the text holds the space mark itself). A null
    or empty text has no ids; an empty table gives no rows; other columns are not read.
    """
    names = ["_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"] + ["ids"] * keep_ids

    def run(batches):
        both = codec(model)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 2048):
                rows = []
                some = texts[at : at + 2048]
                for doc_id, text, ids in zip(doc_ids[at:], some, both.encode(some)):
                    back = both.decode(ids)
                    row = (doc_id, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text)
                    rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if keep_ids else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * keep_ids
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def decode_documents(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` from arrays of ids. A null array, one that holds a null and one with an id that the vocabulary lacks
    give a null text, an empty one an empty text; an empty table gives no rows; other columns are not read."""

    def run(batches):
        both = codec(model)
        size = len(both.pieces.bytes_of)
        for batch in batches:
            known = [x is not None and all(i is not None and 0 <= i < size for i in x) for x in batch.column(1).to_pylist()]
            texts = [both.decode(np.array(x, "<u4").tobytes()) if ok else None for x, ok in zip(batch.column(1).to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    source = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    return source.mapInArrow(run, "_id long, text string").withColumnRenamed("_id", id_col)
