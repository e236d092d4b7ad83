"""Alignment of two tokenizers: which of their tokens share bytes of a text, and how often ids meet in a corpus."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vesperline.llm._spark import as_table

_MARK = "▁"  # fixed value: the piece alphabet's space
_KNOWN_LINKS = 3 << 18  # a worker forgets its parts beyond this many links
_BYTES_AT_ONCE = 1 << 16
_CHARS_AT_ONCE = 1 << 20
_NO_TOKENS = -1


@dataclass
class Matrix:
    """A sparse matrix of ones in compressed rows: row i holds the columns ``indices[indptr[i] : indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.indptr) - 1

    def row_of_each(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.indptr))

    @staticmethod
    def intervals(sizes: np.ndarray) -> Matrix:
        """Row i holds the next ``sizes[i]`` columns: tokens over bytes, or groups over tokens."""
        indptr = np.concatenate(([0], np.cumsum(sizes)))
        return Matrix(indptr, np.arange(indptr[-1]), int(indptr[-1]))

    def transposed(self) -> Matrix:
        by = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=self.columns))))
        return Matrix(indptr, self.row_of_each()[by], self.rows)


def product(a: Matrix, b: Matrix) -> Matrix:
    """Gustavson's product by rows: row i of the result merges the rows of ``b`` that row i of ``a`` names; equal columns
    become one."""
    met = np.diff(b.indptr)[a.indices]
    ends = np.cumsum(met)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(b.indptr[a.indices] - ends + met, met)
    key = np.repeat(a.row_of_each(), met) * b.columns + b.indices[at]
    if (key[1:] < key[:-1]).any():
        key = np.sort(key)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    row = key // max(1, b.columns)
    return Matrix(np.searchsorted(row, np.arange(a.rows + 1)), key - row * b.columns, b.columns)


def shared_groups(ga: Matrix, gb: Matrix, links_at_once: int = 1 << 20) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(A tokens, B tokens) of the links of tokens in one group, by blocks of groups: the product of the groups' A side,
    transposed, with their B side. Only a group that holds more links alone makes a larger block."""
    links = np.cumsum(np.diff(ga.indptr) * np.diff(gb.indptr))
    cuts = [0, *(np.flatnonzero(np.diff(links // links_at_once)) + 1).tolist(), ga.rows]
    for begin, stop in zip(cuts, cuts[1:]):
        part = lambda m: Matrix(m.indptr[begin : stop + 1] - m.indptr[begin], m.indices[m.indptr[begin] : m.indptr[stop]] - m.indptr[begin], int(m.indptr[stop] - m.indptr[begin]))
        a, b = part(ga), part(gb)
        found = product(a.transposed(), b)
        yield found.row_of_each() + ga.indptr[begin], found.indices + gb.indptr[begin]


@dataclass
class Aligned:
    """The alignment of the two tokenizations of one stretch of bytes."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    ends_a: np.ndarray
    ends_b: np.ndarray
    links: Matrix  # A tokens by B tokens
    groups_a: Matrix  # groups by A tokens
    groups_b: Matrix
    group_ends: np.ndarray


def align(ids_a: np.ndarray, sizes_a: np.ndarray, ids_b: np.ndarray, sizes_b: np.ndarray) -> Aligned:
    """Tokens with their sizes in bytes, both over the same bytes -> links and groups."""
    a, b = Matrix.intervals(sizes_a), Matrix.intervals(sizes_b)
    ends_a, ends_b = a.indptr[1:], b.indptr[1:]
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    groups = [Matrix.intervals(np.diff(np.searchsorted(ends, common, "right"), prepend=0)) for ends in (ends_a, ends_b)]
    return Aligned(ids_a, ids_b, ends_a, ends_b, product(a, b.transposed()), *groups, common)


class Tokens:
    """Both vocabularies as ids and bytes."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(byte_bpe)
        a.encode_special_tokens = True  # their strings in a text are plain text
        self._encode_a = a.encode_batch_fast
        self._encode_b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        n = self._encode_b.get_piece_size()
        names = [self._encode_b.id_to_piece(i) for i in range(n)]
        if any(_MARK in t.lstrip(_MARK) for t in names) or any("\n" in t for t in names):
            raise ValueError("a piece goes on past a space or a line end: parts would not be independent")
        alphabet = _byte_alphabet()
        self.bytes_a = [b""] * (max(a.get_vocab().values()) + 1)
        for token, i in a.get_vocab().items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        as_byte = re.compile("<0x([0-9A-F]{2})>$")
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := as_byte.match(t)) and self._encode_b.is_byte(i) else t.replace(_MARK, " ").encode() for i, t in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space_b = self._encode_b.piece_to_id(_MARK)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text that begins with a space or a line end; None where their bytes are not the text's."""
        a = self._encode_a([text], add_special_tokens=False)[0].ids
        b = self._encode_b.encode(text[1:] if text[0] == " " else text, num_threads=1)
        if text[0] != " ":  # the space that B adds stands alone, for no piece has a line end
            if b[:1] != [self.space_b]:
                return None
            b = b[1:]
        raw = text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


#: Between other characters, both tokenizers begin a token at a space and at a line end.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_JOINS = re.compile(r"[ \n]\S(?:.*\S)?", re.S)


class Aligner:
    """Alignments of whole texts, put together from those of their parts.

    A text with its leading space falls into parts at spaces and line ends that stand alone; both tokenizers begin a
    token there, so tokens, links and groups of a text are those of its parts in order. Parts are aligned once, many
    new ones at a time, and kept until they hold too many links.
    """

    def __init__(self, tokens: Tokens):
        self._tokens = tokens
        n_a, n_b = len(tokens.bytes_a), len(tokens.bytes_b)
        self._texts_a = [f"{i}{end}" for i in range(n_a) for end in ",|"]
        self._texts = self._texts_a + [f"{i}{end}" for i in range(n_b) for end in ",;"]
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._written: list[str] = []
        self._sums = np.empty((0, 5), np.int64)  # A tokens, B tokens, groups, links, links within groups; all -1: no tokens
        self._starts, self._pairs = np.zeros(1, np.int64), np.empty(0, np.int64)

    def _add(self, parts: list[str]) -> None:
        """New parts: those that neighbours cannot change are tokenized together, the others each on its own."""
        apart, joined, size = [], [[]], 0
        for p in parts:
            if _MARK in p or not _JOINS.fullmatch(p):
                apart.append([p])
            else:
                joined[-1].append(p)
                size += len(p)
                if size > _BYTES_AT_ONCE:
                    joined.append([])
                    size = 0
        for some in [*filter(None, joined), *apart]:
            self._add_block(some)

    def _add_block(self, parts: list[str]) -> None:
        ids = None if any(_MARK in p for p in parts) else self._tokens.encode("".join(parts))
        ends = np.cumsum([len(p.encode()) for p in parts])
        if ids is None and len(parts) == 1:
            return self._keep(parts, [""], np.full((1, 5), _NO_TOKENS), [0], np.empty(0, np.int64))
        found = ids and align(ids[0], self._tokens.size_a[ids[0]], ids[1], self._tokens.size_b[ids[1]])
        if not found or not np.isin(ends, found.group_ends).all():
            for p in parts:
                self._add_block([p])
            return None
        group_at, a_at, b_at = (np.searchsorted(e, ends, "right") for e in (found.group_ends, found.ends_a, found.ends_b))
        link_at = found.links.indptr[a_at]
        within = np.cumsum(np.diff(found.groups_a.indptr) * np.diff(found.groups_b.indptr))[group_at - 1]
        sums = np.diff(np.stack([a_at, b_at, group_at, link_at, within], 1), axis=0, prepend=0)
        # a group's A tokens, then its B tokens; the last of each closes it
        order, ga, gb = np.empty(len(ids[0]) + len(ids[1]), np.int64), found.groups_a.indptr, found.groups_b.indptr
        last_a, last_b = np.zeros(len(ids[0]), np.int64), np.zeros(len(ids[1]), np.int64)
        last_a[ga[1:] - 1], last_b[gb[1:] - 1] = 1, 1
        order[np.arange(len(ids[0])) + gb[found.groups_a.row_of_each()]] = 2 * ids[0] + last_a
        order[np.arange(len(ids[1])) + ga[found.groups_b.row_of_each() + 1]] = len(self._texts_a) + 2 * ids[1] + last_b
        texts = list(map(self._texts.__getitem__, order.tolist()))
        cuts = [0, *(a_at + b_at).tolist()]
        written = ["".join(texts[s:e]) for s, e in zip(cuts, cuts[1:])]
        pairs = (ids[0][found.links.row_of_each()] << 32) | ids[1][found.links.indices]
        self._keep(parts, written, sums, np.diff(link_at, prepend=0), pairs)

    def _keep(self, parts, written, sums, sizes, pairs) -> None:
        self._place.update((p, len(self._written) + k) for k, p in enumerate(parts))
        self._written += written
        self._new.append((sums, sizes, pairs))

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """For each text (sums, digest of the groups, different id pairs, how often each is linked in it)."""
        if len(self._pairs) > _KNOWN_LINKS:
            self._forget()
        self._new: list = []
        parts = [_CUT.split(" " + t) if t else [] for t in texts]
        new = list(dict.fromkeys(p for ps in parts for p in ps if p not in self._place))
        if new:
            self._add(new)
            sums, sizes, pairs = zip(*self._new)
            self._sums = np.concatenate([self._sums, *sums])
            self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(np.concatenate(sizes), dtype=np.int64)])
            self._pairs = np.concatenate([self._pairs, *pairs])
        return [self._document(ps) for ps in parts]

    def _document(self, parts: list[str]) -> tuple:
        nothing = ((0,) * 5, "", np.empty(0, np.int64), np.empty(0, np.int64))
        if not parts:
            return nothing
        at = list(map(self._place.__getitem__, parts))
        places = np.array(at)
        sums = self._sums[places]
        if sums[:, 0].min() < 0:
            return nothing
        groups = "".join(map(self._written.__getitem__, at))[:-1]
        counts = sums[:, 3]
        ends = np.cumsum(counts)
        pairs = self._pairs[np.repeat(self._starts[places] - ends + counts, counts) + np.arange(ends[-1])]
        return tuple(sums.sum(0).tolist()), hashlib.sha256(groups.encode()).hexdigest(), *np.unique(pairs, return_counts=True)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    if (byte_bpe, piece_bpe) not in _aligners:
        _aligners[byte_bpe, piece_bpe] = Aligner(Tokens(byte_bpe, piece_bpe))
    return _aligners[byte_bpe, piece_bpe]


_SUMS = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]
_ALIGNED = ", ".join(["_id long", "batch long", *(f"{c} long" for c in _SUMS), "groups_sha256 string", "codes array<int>", "times array<int>", "pairs array<bigint>", "held array<int>"])


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0), kind))


def aligned_documents(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 23) -> DataFrame:
    """Each document's sums, digest and linked id pairs, in batches of about ``batch_chars`` characters.

    A batch numbers its different pairs: ``codes`` and ``times`` of a document are their numbers and how often each is
    linked; the batch's first row has the ``pairs`` by number and the number of documents that hold each.
    """

    def batch_of(ids: list, found: list[tuple], number: int) -> pa.RecordBatch:
        each = [f[2] for f in found]
        pairs, codes, held = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        codes = np.split(codes, np.cumsum([len(x) for x in each])[:-1])
        once = lambda x, kind: pa.array([x, *[None] * (len(ids) - 1)], pa.list_(kind))
        columns = [pa.array(ids, pa.int64()), pa.array([number] * len(ids), pa.int64())]
        columns += [pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(_SUMS))]
        columns += [pa.array([f[1] for f in found], pa.string()), _lists(codes, pa.int32()), _lists([f[3] for f in found], pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, once(pairs, pa.int64()), once(held, pa.int32())], ["_id", "batch", *_SUMS, "groups_sha256", "codes", "times", "pairs", "held"])

    def run(batches: Iterable[pa.RecordBatch]):
        align_with = aligner(byte_bpe, piece_bpe)
        number, ids, found, size = TaskContext.get().partitionId() << 32, [], [], 0
        waiting: list[tuple] = []
        chars = 0

        def flush():
            found.extend(align_with.documents([t for _, t in waiting]))
            ids.extend(i for i, _ in waiting)
            waiting.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                waiting.append((doc_id, text))
                chars += len(text or "")
                size += len(text or "") + 64  # short texts are rows too
                if chars > _CHARS_AT_ONCE or len(waiting) >= 10_000:
                    flush()
                    chars = 0
                if size > batch_chars:
                    flush()
                    yield batch_of(ids, found, number)
                    number, ids, found, size, chars = number + 1, [], [], 0, 0
        flush()
        if ids:
            yield batch_of(ids, found, number)

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, _ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, n, best)`` of a whole corpus: how many documents hold the id pair linked, and whether that is the highest
    number of its A id. A pair is A's id times 2**32 plus B's."""
    held = aligned.where("pairs is not null").select(F.inline(F.arrays_zip("pairs", "held"))).toDF("pair", "held")
    counts = held.groupBy("pair").agg(F.sum("held").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))  # an A id has as many pairs as B has ids
    return counts.select("pair", "n", (F.col("n") == top).alias("best"))


def align_documents(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 23) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_group_links, groups_sha256, n_best, count_sum)`` for every document.

    Counts go back to documents by batch: a pair comes to a batch once, however many of its documents hold it, so one
    that all documents hold is no hot key. Texts that are null or empty, or that the tokens' bytes do not give back,
    have no tokens: zeros and an empty digest. Repeated rows count as documents of their own; an empty table gives no
    rows; other columns are not read.
    """
    aligned = as_table(aligned_documents(docs, byte_bpe, piece_bpe, id_col, text_col, batch_chars))
    numbered = aligned.where("pairs is not null").select(F.col("batch").alias("_batch"), F.posexplode("pairs").alias("code", "pair"))
    answers = numbered.join(pair_counts(aligned), "pair").select("_batch", "code", "n", "best")
    columns = ["_id", *_SUMS, "groups_sha256"]

    def run(rows: pa.Table, counts: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        value = np.zeros((2, counts.num_rows), np.int64)
        code = counts["code"].to_numpy()
        value[0, code], value[1, code] = counts["best"].to_numpy(), counts["n"].to_numpy()
        codes, times = (rows[c].combine_chunks() for c in ("codes", "times"))
        offsets = codes.offsets.to_numpy()
        each = value[:, codes.values.to_numpy()[offsets[0] : offsets[-1]]] * times.values.to_numpy()[offsets[0] : offsets[-1]]
        sums = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(each, 1)), 1)[:, offsets - offsets[0]]
        out = rows.select(columns)
        return out.append_column("n_best", pa.array(np.diff(sums[0]))).append_column("count_sum", pa.array(np.diff(sums[1])))

    schema = "_id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", groups_sha256 string, n_best long, count_sum long"
    left = aligned.select("batch", *columns, "codes", "times").groupBy("batch")
    return left.cogroup(answers.groupBy("_batch")).applyInArrow(run, schema).withColumnRenamed("_id", id_col)


def group_links(docs: DataFrame, byte_bpe: str, piece_bpe: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, a, b, overlaps)``: every pair of an A and a B token of one group, as their places in the text, and whether
    they share bytes. A group's pairs are as many as its A tokens times its B tokens; they come in blocks."""

    def run(batches: Iterable[pa.RecordBatch]):
        tokens = aligner(byte_bpe, piece_bpe)._tokens
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokens.encode(" " + text) if text and _MARK not in text else None
                if ids is None:
                    continue
                found = align(ids[0], tokens.size_a[ids[0]], ids[1], tokens.size_b[ids[1]])
                linked = found.links.row_of_each() * len(ids[1]) + found.links.indices
                for a, b in shared_groups(found.groups_a, found.groups_b):
                    overlaps = np.isin(a * len(ids[1]) + b, linked)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(a), pa.int64()), pa.array(a), pa.array(b), pa.array(overlaps)], ["_id", "a", "b", "overlaps"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, "_id long, a long, b long, overlaps boolean").withColumnRenamed("_id", id_col)
