"""Best-fit packing of token pieces into fixed-length sequences."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperline.llm._spark import as_table

_KNOWN_PARTS = 1 << 20  # a worker forgets its parts beyond this many
_CHARS_AT_ONCE = 1 << 24
_PARTS_AT_ONCE = 1 << 12
_WORD_END = "</w>"  # fixed value: the end of the last token of a run of letters
#: Latin, Greek and Cyrillic letters, none of which normalises to a letter with a combining mark; then ASCII marks
#: but the apostrophe, which may begin a token of its own kind: 's, 't, 're.
_LETTERS = (
    r"A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
    r"\x{386}\x{388}-\x{38A}\x{38C}\x{38E}-\x{3A1}\x{3A3}-\x{3CE}\x{400}-\x{481}\x{48A}-\x{52F}"
)
_LETTERS_MARKS = rf"^(?P<letters>[{_LETTERS}]+)(?P<marks>[!-&(-/:-@\[-`{{-~]*)$"


class WordEncoder:
    """Token ids of whole texts, with the ids of each part of a chunk between white space kept for the next time.

    The tokenizer drops white space, lower-cases, and never joins letters with other marks, so a text's ids are its
    chunks' ids in order, and the ids of letters with marks behind them are those of the letters and of the marks. That
    is used for letters whose normal form is letters again; other chunks are encoded as they stand. Ids of known parts
    lie in one array, from which a batch of texts is gathered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = tokenizer.encode_batch_fast
        vocabulary = tokenizer.get_vocab()
        self._word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self._word_end[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self._known = pa.array([""])
        self._starts, self._sizes, self._ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32)

    def _add(self, parts: pa.Array, ids: list[np.ndarray], sizes: np.ndarray) -> None:
        self._known = pa.concat_arrays([self._known, parts])
        self._starts = np.concatenate((self._starts, len(self._ids) + np.cumsum(sizes) - sizes))
        self._sizes = np.concatenate((self._sizes, sizes))
        self._ids = np.concatenate([self._ids, *ids])

    def _add_letters(self, parts: pa.Array) -> None:
        """Many at once: a run of letters has one word end, at its end."""
        ids, sizes = [], []
        for at in range(0, len(parts), _PARTS_AT_ONCE):
            some = parts.slice(at, _PARTS_AT_ONCE)
            text = pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), " ")[0].as_py()
            ids.append(np.array(self._encode([text], add_special_tokens=False)[0].ids, np.uint32))
            ends = np.flatnonzero(self._word_end[ids[-1]]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not close a run of letters with one word end")
            sizes.append(np.diff(ends, prepend=0))
        self._add(parts, ids, np.concatenate(sizes))

    def _add_others(self, parts: pa.Array) -> None:
        ids = [np.array(e.ids, np.uint32) for e in self._encode(parts.to_pylist(), add_special_tokens=False)]
        self._add(parts, ids, np.fromiter(map(len, ids), np.int64, len(ids)))

    def _places(self, parts: pa.Array, add: Callable[[pa.Array], None]) -> np.ndarray:
        """Where each part's ids are; new parts are added first."""
        coded = pc.dictionary_encode(parts)
        new = coded.dictionary.filter(pc.invert(pc.is_in(coded.dictionary, value_set=self._known)))
        if len(new):
            add(new)
        return pc.index_in(coded.dictionary, value_set=self._known).to_numpy()[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text; a null is empty."""
        if len(self._known) > _KNOWN_PARTS:
            self._forget()
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = pc.dictionary_encode(words.flatten())
        split = pc.extract_regex(coded.dictionary, _LETTERS_MARKS)
        plain = pc.is_valid(split)
        at, regular = np.zeros((len(plain), 2), np.int64), plain.to_numpy(zero_copy_only=False)
        letters, marks = split.filter(plain).flatten()
        at[regular, 0] = self._places(pc.utf8_lower(letters), self._add_letters)
        at[regular, 1] = self._places(marks, self._add_others)
        at[~regular, 0] = self._places(coded.dictionary.filter(pc.invert(plain)), self._add_others)
        ids, sizes = _gathered(self._ids, self._starts, self._sizes, at.reshape(-1))
        sizes = sizes.reshape(-1, 2).sum(1)
        place = coded.indices.to_numpy()
        out, counts = _gathered(ids, np.cumsum(sizes) - sizes, sizes, place)
        cuts = np.concatenate(([0], np.cumsum(counts)))[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return np.split(out, cuts[1:-1]) if len(texts) else []


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ids`` at some places one after another, and their sizes."""
    counts = sizes.astype(np.int32)[place]
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts[place] - ends + counts, counts)
    index += np.arange(total)
    return ids[index], counts


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: each text's ids and ``end_id``, cut only beyond ``capacity``.

    A null or empty text is one piece that holds ``end_id`` alone; an empty table gives no rows; other columns
    are not read.
    """
    end = np.array([end_id], np.uint32)
    names = ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def pieces_of(doc_ids: list, texts: pa.Array) -> pa.RecordBatch:
        rows = []
        for doc_id, ids in zip(doc_ids, encoder(tokenizer).encode(texts)):
            ids = np.concatenate((ids, end)).astype("<u4", copy=False)
            for piece, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                row = (doc_id, piece, at, len(part), zlib.crc32(part))
                rows.append((*row, part.astype(np.int32)) if keep_ids else row)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            doc_ids, sizes = batch.column(0).to_pylist(), pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            full = np.cumsum(sizes) // _CHARS_AT_ONCE
            cuts = [0, *(np.flatnonzero(full[1:] != full[:-1]) + 1).tolist(), len(doc_ids)]
            for begin, stop in zip(cuts, cuts[1:]):
                if begin < stop:
                    yield pieces_of(doc_ids[begin:stop], batch.column(1).slice(begin, stop - begin))

    schema = "_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, in order of arrival, with ``open_bins`` bins open at most.

    Open bins are kept by their free space, and a bitset has a bit for each free space that some bin has: the
    tightest bin that takes an item is its lowest bit at or above the item's length. When one bin too many is
    open, the fullest closes.
    """
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits, n_open, n_bins = 0, 0, 0
    bins, offsets = [], []
    for length in lengths:
        fits = free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
            n_open -= 1
        else:
            free, at = capacity, n_bins
            n_bins += 1
        bins.append(at)
        offsets.append(capacity - free)
        if free := free - length:
            if n_open == open_bins:
                least = (free_bits & -free_bits).bit_length() - 1 if free_bits else free
                if least >= free:
                    continue  # the bin just filled is the fullest: it closes
                by_free[least].pop()
                if not by_free[least]:
                    free_bits ^= 1 << least
                n_open -= 1
            by_free[free].append(at)
            free_bits |= 1 << free
            n_open += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 256, arrivals: int = 2000, tokens_per_group: int = 1 << 24, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: each sequence is gapless from 0 and holds ``capacity`` tokens at most.

    Pieces are dealt by a hash of their key into groups of about ``tokens_per_group`` tokens, whatever the input's
    size; each group is a stream that is packed on its own, so no task's work grows with the input and only a fraction
    of a sequence per group is lost. A stream comes in by key, ``arrivals`` pieces at a time, the longest of them first:
    their short pieces fill what the long ones opened, so ``open_bins`` bins suffice. A null id or length counts as 0;
    an empty table gives no rows; other columns are kept, but for a ``sequence_id`` and an ``offset`` of before.
    ``pieces`` is read twice and should be a written table.
    """
    total = pieces.agg(F.sum(F.coalesce("length", F.lit(0)) + capacity // 16)).first()[0] or 0  # short pieces are rows too
    groups = max(1, round(total / tokens_per_group))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(names)
    key_name = "_group" + "_" * max(map(len, names))  # no column has this name

    def run(key: tuple, data: pa.Table) -> pa.Table:
        group = key[0].as_py()
        value = lambda name: pc.fill_null(data[name], 0).to_numpy()
        lengths = value("length")
        came = np.lexsort((lengths, value("piece"), value(id_col)))
        order = came[np.lexsort((-lengths[came], np.arange(len(came)) // arrivals))]
        data = data.take(pa.array(order))
        bins, offsets = best_fit(lengths[order].tolist(), capacity, open_bins)
        ids = pa.array(np.array(bins, np.int64) + (group << 40))
        return data.select(names).append_column("sequence_id", ids).append_column("offset", pa.array(offsets, pa.int64()))

    dealt_by = [id_col] + [c for c in ("piece", "start", "length", "ids_crc32") if c in names]  # more than the id: it may be null
    keyed = pieces.withColumn(key_name, F.pmod(F.xxhash64(*dealt_by), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return keyed.groupBy(key_name).applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenize and pack whole documents; see :func:`token_pieces` and :func:`pack`."""
    return pack(as_table(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids)), capacity, id_col=id_col)
