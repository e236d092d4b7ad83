"""Removal of repeated byte strings: prefix-free parsing, then suffix order of the dictionary's words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperline.llm import _repeats
from vesperline.llm._repeats import Config, Units, Words

_VALUES = _repeats.byte_values()


def byte_units(text: str | bytes | None) -> Units:
    data = text if isinstance(text, bytes) else (text or "").encode()
    return Units(_VALUES[np.frombuffer(data, np.uint8)], data, None, None)


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Classes of the ``length``-byte strings at each position, numbered in suffix order: a suffix array by prefix
    doubling that stops at this depth. Positions with fewer bytes left are left out."""
    rank, size = data.astype(np.int64), 1
    while size < length:
        step = min(size, length - size)
        pair = rank[: len(rank) - step] * (int(rank.max(initial=0)) + 1) + rank[step:]
        order = np.argsort(pair, kind="stable")
        new = np.concatenate(([False], pair[order][1:] != pair[order][:-1]))[: len(order)]
        rank = np.empty(len(pair), np.int64)
        rank[order] = np.cumsum(new)
        size += step
    return rank


def suffix_classes(words: Words, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that recur by the suffix order of the concatenation of the dictionary's words that hold one."""
    words, windows, again = _repeats.recurring_words(words, config)
    if not len(again):
        return (np.empty(0, np.int64),) * 3
    sizes = np.array([len(u.data) for u in words.units])
    ranks = prefix_ranks(np.frombuffer(b"".join(u.data for u in words.units), np.uint8), config.length)
    owner, inside = windows.owner[again], windows.inside[again]
    return ranks[(np.cumsum(sizes) - sizes)[owner] + inside], np.array(words.doc, np.int64)[owner], np.array(words.start, np.int64)[owner] + inside


def _widened(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of bytes moved out to the borders of UTF-8 characters; those that then meet are one."""
    out: list[tuple[int, int]] = []
    for start, end in runs:
        while data[start] & 0xC0 == 0x80:
            start -= 1
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        if out and start <= out[-1][1]:
            start = out.pop()[0]
        out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, length: int = 100, width: int = 24, crowd: int = 512, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept)``: each text's UTF-8 bytes without those covered by a ``length``-byte
    string that also starts earlier (in a document with a smaller id, or earlier in the same one).

    Strings are judged on the input; overlapping ones count; matches never cross documents. A null text is empty; an
    empty table gives no rows; other columns are not read. An id names one document: its repeated rows give repeated
    results. A row without an id takes no part and is returned whole. ``kept`` is binary, for a cut may split a
    character; with ``whole_characters`` each cut is widened to the borders of the characters it splits. ``carry`` names
    columns to return beside these.
    """
    carry = carry or []

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                data = (text.as_py() or "").encode()
                runs = _repeats.runs_of(spans)
                if whole_characters:
                    runs = _widened(data, runs)
                at, parts = 0, []
                for start, end in runs:
                    parts.append(data[at:start])
                    at = end
                rows.append((len(data), sum(e - s for s, e in runs), len(runs), b"".join([*parts, data[at:]])))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.binary()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["_id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    found = _repeats.with_spans(docs, Config(length, width, byte_units, crowd), suffix_classes, id_col, text_col, carry)
    kind = found.schema["rest"].dataType.simpleString()
    out = found.mapInArrow(run, f"_id long, n_bytes long, n_removed long, n_spans long, kept binary, rest {kind}")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", *[F.col("rest")[c].alias(c) for c in carry])
