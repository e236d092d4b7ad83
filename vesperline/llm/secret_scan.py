"""Secrets in text, also under nested URL, Unicode, base64 and compressed layers."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
# Python's re is asked for ASCII case only: without it K (Kelvin) or a long s would match too.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_ESCAPE = re.compile(r"%(?P<url>[0-9A-Fa-f]{2})|\\u\{(?P<braced>[0-9A-Fa-f]{1,6})\}|\\u(?P<u>[0-9A-Fa-f]{4})|\\x(?P<x>[0-9A-Fa-f]{2})|&#(?P<dec>[0-9]{1,7});|&#[xX](?P<hex>[0-9A-Fa-f]{1,6});")
_REACH = 9  # the longest escape has ten characters
_RAW_BYTES = re.compile("[\x00-\x7f\udc80-\udcff]+")
_RAW_ZIPPED = re.compile("\x1f\udc8b\x08|x[\x01\x5e\udc9c\udcda]")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}={0,2}")
#: Base64 over line ends, indented alike; the last line may be short.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}[\x20\t]*\r?\n(?P<indent>[\x20\t]*+)(?:[A-Za-z0-9+/_-]{12,}[\x20\t]*\r?\n(?P=indent))*[A-Za-z0-9+/_-]++={0,2}")
_ZIPPED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: Bytes written as escapes among plain characters, where they may hold a compressed stream.
_URL_BYTES = (re.compile(r"%1[Ff]%8[Bb]|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa])"), re.compile(r"(?:%[0-9A-Fa-f]{2}|[!$&-;=?-Z_a-z~])+"), re.compile(r"%([0-9A-Fa-f]{2})|."), "url")
_X_BYTES = (re.compile(r"\\x1[Ff]\\x8[Bb]|(?:x|\\x78)(?:\\x01|\^|\\x5[Ee]|\\x9[Cc]|\\x[Dd][Aa])"), re.compile(r"""(?:\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'"]|[\x20-\x5b\x5d-\x7e])+"""), re.compile(r"\\x([0-9A-Fa-f]{2})|\\?."), "unicode")
_ESCAPED = dict(zip("abfnrtv0", "\a\b\f\n\r\t\v\0"))
#: Without any of these a text holds neither a finding nor a layer.
_MAY_HOLD = re.compile(r"[A-Za-z0-9+/_-]{12}|[:=]|%[0-9A-Fa-f]{2}|\\[ux]|&#")


class Span(NamedTuple):
    """A finding in code points of the original text; ``codecs`` are the layers around it, outermost first."""

    start: int
    kind: int
    end: int
    codecs: str


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost non-overlapping for each kind, by start and then kind."""
    found = []
    lower = text.lower()
    if any(word in lower for word in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


class _Layer(NamedTuple):
    """A text and, for runs of its characters, where they stand in the original: (at, start, end, one_to_one)."""

    text: str
    runs: list[tuple[int, int, int, bool]]
    codecs: tuple[str, ...]

    def place(self, start: int, end: int) -> tuple[int, int]:
        first = self.runs[bisect_right(self.runs, (start, 1 << 60)) - 1]
        last = self.runs[bisect_right(self.runs, (end - 1, 1 << 60)) - 1]
        begin = first[1] + start - first[0] if first[3] else first[1]
        return begin, last[1] + end - last[0] if last[3] else last[2]


def _escape_char(m: re.Match) -> str:
    """What one escape stands for; a byte that is not ASCII becomes a low surrogate until its neighbours are known."""
    code = int(m[m.lastgroup], 10 if m.lastgroup == "dec" else 16)
    if m.lastgroup == "url":
        return chr(code if code < 0x80 else 0xDC00 + code)
    return "\ufffd" if code >= 0x110000 or 0xDC80 <= code <= 0xDCFF else chr(code)


def _reduced(text: str) -> tuple[list[tuple[str, int, int, bool]], set[str]]:
    """The text's pieces (string, start, end, as_written) with URL and Unicode escapes unwrapped until none is left, and
    the codecs met. What an escape stands for may begin, continue or end another escape with its neighbours; only these
    few characters are looked at again, so the work is in proportion to the text however deep the escapes are."""
    pieces: list[tuple[str, int, int, bool]] = []
    codecs, at = set(), 0
    while m := _ESCAPE.search(text, at):
        if at < m.start():
            pieces.append((text[at : m.start()], at, m.start(), True))
        start, at = m.start(), m.end()
        while m:
            codecs.add("url" if m.lastgroup == "url" else "unicode")
            char = _escape_char(m)
            left, k = "", len(pieces)
            while k and len(left) < _REACH:
                k -= 1
                left = pieces[k][0][-_REACH:] + left
            left = left[-_REACH:]
            near = left + char + text[at : at + _REACH]
            for begin in range(len(left) + 1):
                if near[begin] in "%\\&" and (m := _ESCAPE.match(near, begin)) and m.end() > len(left):
                    break
            else:
                m = None
            if m:
                at += m.end() - len(left) - 1
                taken = len(left) - m.start()
                while taken:  # characters before it that now belong to an escape
                    string, first, last, written = pieces.pop()
                    if len(string) > taken:
                        keep = len(string) - taken
                        pieces.append((string[:keep], first, first + keep if written else last, written))
                        start = first + keep if written else first
                        taken = 0
                    else:
                        taken -= len(string)
                        start = first
        if "\ud800" <= char <= "\udbff" or not ("\udc00" <= char <= "\udc7f" or "\udd00" <= char <= "\udfff"):
            pieces.append((char, start, at, False))
        elif pieces and not pieces[-1][3] and "\ud800" <= pieces[-1][0] <= "\udbff":
            high, first, _, _ = pieces.pop()
            pieces.append(((high + char).encode("utf-16", "surrogatepass").decode("utf-16"), first, at, False))
        else:
            pieces.append(("\ufffd", start, at, False))
    if at < len(text):
        pieces.append((text[at:], at, len(text), True))
    return pieces, codecs


def _unescaped(layer: _Layer):
    """The layer without escapes, and what is compressed in the bytes they stood for."""
    if "%" not in layer.text and "\\" not in layer.text and "&#" not in layer.text:
        return
    pieces, codecs = _reduced(layer.text)
    if not codecs:
        return
    name = "+".join(sorted(codecs, reverse=True))
    raw, runs, size, k = "".join(p[0] for p in pieces), [], 0, 0
    out: list[str] = []
    while k < len(pieces):
        string, start, end, written = pieces[k]
        k += 1
        if not written and "\udc80" <= string <= "\udcff":  # bytes of one or more characters
            data = [string]
            while k < len(pieces) and not pieces[k][3] and "\udc80" <= pieces[k][0] <= "\udcff":
                data.append(pieces[k][0])
                end = pieces[k][2]
                k += 1
            string = "".join(data).encode("ascii", "surrogateescape").decode(errors="replace")
        elif not written and "\ud800" <= string <= "\udbff":
            string = "\ufffd"
        if written:  # where the layer's own runs change, so do these
            first = bisect_right(layer.runs, (start, 1 << 60)) - 1
            while start < end:
                stop = min(end, layer.runs[first + 1][0]) if first + 1 < len(layer.runs) else end
                place = layer.place(start, stop)
                runs.append((size, *place, layer.runs[first][3]))
                size += stop - start
                start, first = stop, first + 1
        else:
            runs.append((size, *layer.place(start, end), False))
            size += len(string)
        out.append(string)
    yield _Layer("".join(out), runs, (*layer.codecs, name))
    if not _RAW_ZIPPED.search(raw):
        return
    begins = [0]
    for p in pieces:
        begins.append(begins[-1] + len(p[0]))

    def origin(at: int, last: bool) -> int:
        string, start, end, written = pieces[bisect_right(begins, at) - 1]
        return start + at - begins[bisect_right(begins, at) - 1] + last if written else (end if last else start)

    for m in _RAW_BYTES.finditer(raw):
        if _RAW_ZIPPED.search(m[0]):
            for start, end, inner in _streams(m[0].encode("ascii", "surrogateescape")):
                place = layer.place(origin(m.start() + start, False), origin(m.start() + end - 1, True))
                for text, codec in _texts(inner, name + "+zip"):
                    yield _Layer(text, [(0, *place, False)], (*layer.codecs, codec))


_PART = 1 << 24  # of what a stream inflates to at once
_OVERLAP = 1 << 16
#: Whether a byte may stand within a run that is decoded or matched as one: base64 over lines, escapes, values.
_IN_RUN = np.zeros(256, bool)
_IN_RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-.%\\&#;{}!$'(),:<>?@[]^`|~*\"\t\n\r\x20", np.uint8)] = True
_BREAKS = 4  # runs, with what parts a name from its value, that a finding may be made of


def _unfinished(out: bytes) -> int:
    """Where the end of a part that may go on in the next one begins: its last runs, and a stream that has not ended."""
    begin, wanted = len(out), _BREAKS
    while begin and wanted > 0:
        stop, begin = begin, max(0, begin - _OVERLAP)
        breaks = np.flatnonzero(~_IN_RUN[np.frombuffer(out, np.uint8, stop - begin, begin)])
        if len(breaks) >= wanted:
            begin += int(breaks[-wanted])
        wanted -= len(breaks)
    begin = min(begin, max(0, len(out) - _OVERLAP))
    for m in _ZIPPED.finditer(out, 0, begin):
        stream, left = zlib.decompressobj(47), out[m.start() :]
        try:
            while left and not stream.eof:
                stream.decompress(left, _PART)
                left = stream.unconsumed_tail
        except zlib.error:
            continue
        if not stream.eof:
            return m.start()
    return begin


def _inflated(data: bytes):
    """(bytes, bytes read) of the gzip or zlib stream at the start of ``data``, up to where it breaks off. A stream that
    inflates to more than a part gives overlapping parts: a part begins with what its predecessor left unfinished, so
    whatever crosses a border is whole in the next part. No more than a part and one run or inner stream is held."""
    stream, left, tail = zlib.decompressobj(47), data, b""
    try:
        while True:
            out = tail + stream.decompress(left, _PART)
            left = stream.unconsumed_tail
            yield out, len(data) - len(left) - len(stream.unused_data)
            if not left or stream.eof:
                return
            tail = out[_unfinished(out) :]
    except zlib.error:
        if tail:
            return
    stream, some, size, at = zlib.decompressobj(47), [], 0, 0
    try:
        for at in range(len(data)):  # noqa: B007
            some.append(stream.decompress(data[at : at + 1]))
            size += len(some[-1])
            if size > _PART:
                out = b"".join(some)
                yield out, at
                some, size = [out[_unfinished(out) :]], 0
    except zlib.error:
        pass
    yield b"".join(some), at


def _streams(data: bytes):
    """(start, end, bytes) of compressed streams anywhere in ``data``, also those that end early."""
    at = 0
    while m := _ZIPPED.search(data, at):
        at = m.start() + 1
        for inner, size in _inflated(data[m.start() :]):
            if inner:
                at = m.start() + max(size, 1)
                yield m.start(), at, inner


def _texts(data: bytes, codec: str):
    """(text, codec) of decoded bytes, and of what is compressed in them at any depth. Undecodable bytes part the text."""
    work = [(data, codec)]
    while work:
        data, codec = work.pop()
        yield data.decode(errors="replace"), codec
        work += [(inner, codec + "+zip") for _, _, inner in _streams(data)]


def _base64_bytes(run: str):
    """The bytes of a base64 run at its four alignments: it may follow other characters of the alphabet."""
    bare = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    for at in range(4):
        part = bare[at:]
        part = part[:-1] if len(part) % 4 == 1 else part
        if len(part) >= 8:
            yield base64.b64decode(part + "=" * (-len(part) % 4))


def _zipped_in(layer: _Layer, magic: re.Pattern, run: re.Pattern, one: re.Pattern, codec: str):
    """Layers of compressed streams whose bytes are written as escapes."""
    if not magic.search(layer.text):
        return
    for m in run.finditer(layer.text):
        if not magic.search(m[0]):
            continue
        data, starts = bytearray(), []
        for x in one.finditer(m[0]):
            starts.append(m.start() + x.start())
            data.append(int(x[1], 16) if x[1] else ord(_ESCAPED.get(x[0][-1], x[0][-1]) if len(x[0]) == 2 else x[0]))
        starts.append(m.end())
        for start, end, inner in _streams(bytes(data)):
            place = layer.place(starts[start], starts[end])
            for text, codecs in _texts(inner, codec + "+zip"):
                yield _Layer(text, [(0, *place, False)], (*layer.codecs, codecs))


def _unwrapped(layer: _Layer):
    yield from _unescaped(layer)
    for escapes in (_URL_BYTES, _X_BYTES):
        yield from _zipped_in(layer, *escapes)
    runs = {m.span(): m[0] for pattern in (_BASE64, _WRAPPED) for m in pattern.finditer(layer.text)}
    for (start, end), run in runs.items():
        for data in _base64_bytes(run):
            for text, codec in _texts(data, "base64"):
                if _MAY_HOLD.search(text):
                    yield _Layer(text, [(0, *layer.place(start, end), False)], (*layer.codecs, codec))


def _mark(text: str, start: int, end: int) -> tuple[bytes, int, int]:
    return hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=16).digest(), start, end


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[Span]]:
    """The base matches, and all spans: base ones and those found under any nesting of layers.

    Layers wait on a worklist until none is new. A layer that was met before at the same place ends its branch,
    so that nested or self-reproducing encodings cannot loop. A finding inside a decoded run gets the span of the
    encoded run in the original text. Base64 is read over line ends and at its four alignments, compressed streams are
    looked for in the bytes of every codec, and undecodable bytes only part a text. URL and Unicode escapes are unwrapped
    to their own fixpoint at once. What inflates to over 16 MiB is read in parts that carry on what the part before left
    unfinished.
    """
    base = base_matches(text)
    spans = {x: Span(*x, "") for x in base}
    seen = {_mark(text, 0, len(text))}
    work = [_Layer(text, [(0, 0, len(text), True)], ())] if text else []
    while work:
        for layer in _unwrapped(work.pop()):
            key = _mark(layer.text, layer.runs[0][1], layer.runs[-1][2])
            if key in seen:
                continue
            seen.add(key)
            work.append(layer)
            for start, kind, end in base_matches(layer.text):
                placed = layer.place(start, end)
                at = (placed[0], kind, placed[1])
                spans.setdefault(at, Span(*at, ">".join(layer.codecs)))
    return base, sorted(spans.values())


def listed(found) -> str:
    return ",".join(f"{KINDS[x[1]]}:{x[0]}:{x[2]}" for x in found)


_SPAN = "array<struct<kind:string,start:int,end:int,codecs:string>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, base_sha256, spans, found)`` for each text.

    ``spans`` lists kind:start:end; ``found`` has the same as structs, with the layers around each. Null and empty
    texts have no findings; an empty table gives no rows; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = scan_text(text or "")
                counts = [sum(k == x[1] for x in base) for k in range(len(KINDS))]
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, listed(spans), [dict(kind=KINDS[s.kind], start=s.start, end=s.end, codecs=s.codecs) for s in spans]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            kinds.append(pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("codecs", pa.string())])))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = f"_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found {_SPAN}"
    return source.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def redacted_text(text: str | None, mask: str) -> str | None:
    """The text with each maximal run of findings replaced by ``mask``."""
    if not text:
        return text
    out, at, end = [], 0, -1
    for span in scan_text(text)[1]:
        if span.start > end:
            if end >= 0:
                out.append(mask)
                at = end
            out.append(text[at : span.start])
        end = max(end, span.end)
    if end < 0:
        return text
    return "".join([*out, mask, text[end:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every finding masked in ``text_col``; a null text stays null, clean texts stay as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [redacted_text(t, mask) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
