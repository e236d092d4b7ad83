"""Removal of repeated word passages: recurring passages confirmed, then located by Aho-Corasick automata in shards."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from vesperline.llm import _repeats
from vesperline.llm._repeats import Config, Units, Words


def word_units(text: str | bytes | None) -> Units:
    """Words between ASCII white space, compared as they stand."""
    words = (text if isinstance(text, bytes) else (text or "").encode()).split()
    digest = xxhash.xxh3_64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(words) else ends
    values = _repeats.mixed(np.fromiter(map(digest, words), np.uint64, len(words)))
    return Units(values, b" ".join(words), begins, ends)


def automaton_classes(words: Words, config: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recurring passages of a shard, located by an automaton.

    Passages that recur are confirmed first: windows whose rolling hash another window of the shard shares. They alone
    are the patterns, over word numbers, so the automaton is as large as what repeats. Then every text of the shard that
    can hold one streams through it, which reports each occurrence, word by word equal.
    """
    words, windows, again = _repeats.recurring_words(words, config)
    if not len(again):
        return (np.empty(0, np.int64),) * 3
    length = config.length
    numbers: dict[bytes, int] = {}
    streams = [tuple([numbers.setdefault(w, len(numbers)) for w in u.data.split(b" ")]) for u in words.units]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    confirmed = {streams[o][i : i + length] for o, i in zip(windows.owner[again].tolist(), windows.inside[again].tolist())}
    for number, pattern in enumerate(confirmed):
        automaton.add_word(pattern, number)
    automaton.make_automaton()
    code, doc, start = [], [], []
    for d, at, stream in zip(words.doc, words.start, streams):
        for last, number in automaton.iter(stream):
            code.append(number)
            doc.append(d)
            start.append(at + last - length + 1)
    return np.array(code, np.int64), np.array(doc, np.int64), np.array(start, np.int64)


def remove_passages(docs: DataFrame, length: int = 20, width: int = 7, crowd: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)``: each text's words, joined by one space, without those covered by ``length``
    consecutive words that also start earlier (in a document with a smaller id, or earlier in the same one).

    Windows are judged on the input and never cross documents. A null text has no words; an empty table gives no rows;
    other columns are not read. An id names one document: its repeated rows give repeated results. A row without an id
    takes no part and is returned whole.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                at, parts = 0, []
                for start, end in _repeats.runs_of(spans):
                    parts += words[at:start]
                    at = end
                parts += words[at:]
                rows.append((len(words), len(words) - len(parts), b" ".join(parts).decode()))
            columns = list(zip(*rows)) or [()] * 3
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["_id", "n_words", "n_removed", "kept"])

    found = _repeats.with_spans(docs, Config(length, width, word_units, crowd), automaton_classes, id_col, text_col, []).drop("rest")
    return found.mapInArrow(run, "_id long, n_words long, n_removed long, kept string").withColumnRenamed("_id", id_col)
