"""Lines of a note to sections of blocks: the one step that has to read a note from its top to its end.

A fence is closed by one of its own character and at least its own length, a paragraph can be a heading by the row
below it, and whether a line is still in a list depends on the lines before. That is a state over the lines of one note,
which windows can follow only by shuffling and sorting every line of the corpus. Here each note is read once where it
lies, in Arrow batches; the marks inside its headings and paragraphs are resolved in the same pass (see ``inline``). All
that is made of the blocks afterwards is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperline.functions import stamps
from vesperline.functions.inline import CLOSE_TAG, OPEN_TAG, code_text, definitions, shown

_LINE = re.compile(
    r"(?P<blank>[ \t]*$)|(?P<fence> {0,3}(?:`{3,}[^`]*$|~{3,}))|(?P<heading> {0,3}#{1,6}(?:[ \t]|$))"
    r"|(?P<rule> {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$)|(?P<indented> {4}| {0,3}\t)|(?P<html> {0,3}<[A-Za-z/!?])|(?P<container> {0,3}(?:>|(?:[-+*]|[0-9]{1,9}[.)])(?:[ \t]|$)))"
)
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_OPENS = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$")
_LINE_END = re.compile(r"\r\n|\n|\r")
_ITEM = re.compile(r"( {0,3}(?:[-+*]|([0-9]{1,9})[.)]))( +|$)(.*)")
_QUOTE = re.compile(r" {0,3}> ?")
#: Names of elements that open a block of HTML.
_ELEMENTS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table "
    "tbody td tfoot th thead title tr track ul"
).replace(" ", "|")
#: How a block of HTML opens and what ends it: a mark on one of its lines, or a blank line.
_HTML = [(re.compile(opens, re.I), closes and re.compile(closes, re.I)) for opens, closes in (
    (r"<(?:script|pre|style|textarea)(?:\s|>|$)", r"</(?:script|pre|style|textarea)>"), (r"<!--", r"-->"), (r"<\?", r"\?>"), (r"<!\[CDATA\[", r"\]\]>"), (r"<![a-z]", r">"),
    (rf"</?(?:{_ELEMENTS})(?:\s|/?>|$)", None),
)]
_TAG_ALONE = re.compile(rf"(?:{OPEN_TAG}|{CLOSE_TAG})[ \t]*$")
_BLANK = re.compile(r"[ \t]*$")


@lru_cache(1000)
def _closing(char: str, size: int) -> re.Pattern:
    return re.compile(rf" {{0,3}}{char}{{{size},}}[ \t]*$")


def _closer(opened: re.Match) -> re.Pattern:
    return _closing(opened[1][0], len(opened[1]))


#: What a line begins with that may be more than text, and what one begins with that closes a fence.
_MARKS, _FENCES = frozenset(" \t`~#-*_<>+0123456789"), frozenset(" `~")


def _lines(text: str) -> list[str]:
    return _LINE_END.split(text) if "\r" in text else text.split("\n")


def _html_end(line: str, in_paragraph: bool) -> re.Pattern | None:
    """What ends the block of HTML that a line opens; None where it opens none. A lone tag of any name opens one too,
    but not within a paragraph."""
    text = line.lstrip(" ")
    for opens, closes in _HTML:
        if opens.match(text):
            return closes or _BLANK
    return _BLANK if not in_paragraph and _TAG_ALONE.match(text) else None


def _item(line: str, in_paragraph: bool) -> re.Match | None:
    """A list item's marker; within a paragraph one that holds something and, with a number, begins at 1."""
    m = _ITEM.match(line)
    return None if m and in_paragraph and (not m[4].strip() or m[2] and int(m[2]) != 1) else m


class _Containers:
    """What is open of quotes, list items and HTML at the top of a note, one within the other; only how far it reaches
    matters. ``labels`` gathers the link definitions inside, ``texts`` the headings and paragraphs where they are asked
    for."""

    def __init__(self, labels: set[str], texts: list[str] | None = None):
        self.labels, self.texts = labels, texts
        self.stack: list[list] = []  # [width or None for a quote, whether nothing stands in it yet]
        self.paragraph: list[str] | None = None
        self.fence = self.html = None

    @property
    def open(self) -> bool:
        return bool(self.stack) or self.html is not None

    def begin(self, line: str) -> None:
        self._content(line.expandtabs(4) if "\t" in line else line)

    def takes(self, line: str) -> bool:
        """Whether a line still stands in what is open; it closes what the line does not reach."""
        rest = line.expandtabs(4) if "\t" in line else line
        depth = 0
        for width, empty in self.stack:
            if width is None:
                m = _QUOTE.match(rest)
                if not m:
                    break
                rest = rest[m.end() :]
            elif rest[:width].strip(" ") or len(rest) < width:
                if rest.strip(" ") or empty:
                    break
                rest = ""
            else:
                rest = rest[width:]
            depth += 1
        if depth < len(self.stack):
            if self.paragraph is not None and rest.strip() and self._goes_on(rest):
                self.paragraph.append(rest)  # lazily
                return True
            self._close_paragraph()
            del self.stack[depth:]
            self.fence = self.html = None
            if not depth:
                return False
        self._content(rest)
        return True

    def _goes_on(self, rest: str) -> bool:
        """Whether a line outside of what holds the paragraph is text of it, and nothing of its own."""
        m = _LINE.match(rest)
        kind = m.lastgroup if m else "text"
        return kind in ("text", "indented") or kind == "html" and not _html_end(rest, False)

    def close(self) -> None:
        self._close_paragraph()

    def _close_paragraph(self) -> None:
        if self.paragraph is not None and (self.texts is not None or self.paragraph[0].lstrip(" ").startswith("[")):
            text = _undefined(self.paragraph, self.labels)
            if self.texts is not None:
                self.texts.append(text)
        self.paragraph = None

    def _content(self, rest: str) -> None:
        if self.fence:
            self.fence = None if self.fence.match(rest) else self.fence
            return
        if self.html:
            self.html = None if self._ends_html(rest) else self.html
            return
        while True:
            m = _LINE.match(rest)
            kind = m.lastgroup if m else "text"
            inside = self.paragraph is not None
            if kind == "blank":
                return self._close_paragraph()
            item = _item(rest, inside) if kind == "container" else None
            if kind == "container" and (m := _QUOTE.match(rest)):
                self._close_paragraph()
                self._filled()
                self.stack.append([None, False])
                rest = rest[m.end() :]
                continue
            if item:
                self._close_paragraph()
                self._filled()
                spaces = len(item[3])
                whole = 1 <= spaces <= 4 and item[4].strip()
                self.stack.append([len(item[1]) + (spaces if whole else 1), not item[4].strip()])
                rest = item[4] if whole or not item[4].strip() else " " * (spaces - 1) + item[4]
                continue
            self._filled()
            if kind == "html":
                self.html = _html_end(rest, inside)
                if self.html:
                    self._close_paragraph()
                    self.html = None if self._ends_html(rest) else self.html
                    return
            if kind == "fence":
                self._close_paragraph()
                self.fence = _closer(_OPENS.match(rest))
            elif kind in ("heading", "rule") or inside and _UNDERLINE.match(rest):
                self._close_paragraph()
                if kind == "heading" and self.texts is not None:
                    self.texts.append(_HEADING.match(rest)[2] or "")
            elif inside:
                self.paragraph.append(rest)
            elif kind != "indented":
                self.paragraph = [rest]
            return

    def _ends_html(self, rest: str) -> bool:
        return bool(self.html.match(rest) if self.html is _BLANK else self.html.search(rest))

    def _filled(self) -> None:
        if self.stack:
            self.stack[-1][1] = False


class _Section:
    __slots__ = ("line", "level", "title", "written", "blocks")

    def __init__(self, line: int, level: int, title: str, written: str | None):
        self.line, self.level, self.title, self.written = line, level, title, written
        self.blocks: list[list] = []  # [at, kind, lines, info]


#: What opens the title of a task by its state.
_STATE = re.compile(r"\s*[*_~\[]*(?:TODO|DONE|CANCELLED|CANCELED)\s")


def sections_of(text: str, labels: set[str] | None = None, cap: int = 0) -> list[_Section]:
    """A note's sections. Text before the first heading is dropped; of the blocks, paragraphs and code stay. Lists,
    quotes and HTML hold neither headings nor blocks of a section. ``labels`` gathers the link definitions; a note is
    read no further than to its ``cap``-th section that opens with a state, for those are tasks whatever stands in them.
    """
    found: list[_Section] = []
    labels = set() if labels is None else labels
    blocks: list[list] = []  # of the section that is open
    closes = None  # of an open fence
    last = lead = ""  # kinds of the line before, and of the last one that is not blank
    blanks = states = 0
    nest = _Containers(labels)
    match = _LINE.match
    for at, line in enumerate(_lines(text), 1):
        if closes:
            if line[:1] in _FENCES and closes.match(line):
                closes, last = None, "fence"
            else:
                blocks[-1][2].append(line)
            continue
        if nest.stack or nest.html is not None:
            if nest.takes(line):
                last = lead = "nested"
                continue
            last = "blank"
        first = line[:1]
        if not first:
            kind = "blank"
        elif first not in _MARKS or first == "`" and not line.startswith("```"):
            kind = "text"
        else:
            m = match(line)
            kind = m.lastgroup if m else "text"
        if last == "text":
            held = blocks[-1][2]
            if kind == "text" and first not in " =-":
                held.append(line)
                continue
            if kind not in ("blank", "fence", "heading") and (row := _UNDERLINE.match(line)) and (rest := _undefined(held, labels)):
                found.append(_Section(blocks.pop()[0], 1 if row[1][0] == "=" else 2, rest.strip(), None))
                states += bool(cap and _STATE.match(found[-1].title))
                blocks, last, lead = found[-1].blocks, "underline", "underline"
                if cap and states > cap:
                    break
                continue
            # an indented line goes on with a paragraph, and so do marks that cannot interrupt it
            goes_on = kind in ("text", "indented") or kind == "html" and not _html_end(line, True)
            if goes_on or kind == "container" and not _QUOTE.match(line) and not _item(line.expandtabs(4), True):
                held.append(line)
                continue
        elif kind == "indented":
            if lead == "indented":
                blocks[-1][2] += [""] * blanks + [line]
            else:
                blocks.append([at, "indented", [line], None])
            last, lead, blanks = kind, kind, 0
            continue
        if kind == "html" and not _html_end(line, False):
            kind = "text"
        if kind == "blank":
            blanks, last = blanks + 1, kind
            continue
        blanks = 0
        if kind == "fence":
            opened = _OPENS.match(line)
            blocks.append([at, "fence", [], opened[2]])
            closes = _closer(opened)
        elif kind == "heading":
            h = _HEADING.match(line)
            found.append(_Section(at, len(h[1]), h[2] or "", line))
            states += bool(cap and _STATE.match(found[-1].title))
            if cap and states > cap:
                break
            blocks = found[-1].blocks
        elif kind == "text":
            blocks.append([at, "text", [line], None])
        elif kind in ("html", "container"):
            nest.begin(line)
        last = lead = kind
    nest.close()
    if cap and states > cap:
        found.pop()
    return found


def _undefined(lines: list[str], labels: set[str]) -> str:
    """A paragraph without the link definitions that it begins with."""
    text = "\n".join(lines)
    if not lines[0].lstrip(" ").startswith("["):
        return text
    names, rest = definitions(text)
    labels.update(names)
    return rest


def _resolved(sections: list[_Section], labels: set[str]) -> list[tuple]:
    """(section, shown title, blocks as they leave: at, kind, body, info, code spans). Definitions may stand anywhere in
    a note, so marks wait for its end."""
    texts = [[b[1] == "text" and _undefined(b[2], labels) for b in s.blocks] for s in sections]
    out = []
    for s, own in zip(sections, texts):
        blocks = []
        for (at, kind, lines, info), text in zip(s.blocks, own):
            if kind != "text":
                blocks.append((at, kind, "\n".join(lines), info, None))
            elif text.strip():
                _, body, codes = shown(text.strip(" \t\n"), labels)
                blocks.append((at, kind, body, None, codes))
        out.append((s, shown(s.title, labels)[0], blocks))
    return out


#: What a stamp holds, and a paragraph of code spans of single backticks alone.
_DATED, _CODES, _CODE = re.compile(r"[<\[][0-9]{4}-[0-9]{2}-[0-9]{2}"), re.compile(r"`[^`]+`(?:[ \t\n]+`[^`]+`)*"), re.compile(r"`([^`]+)`")


def _marked(sections: list[_Section], labels: set[str], properties: bool, clocks: bool) -> list[tuple]:
    """``_resolved`` for those who read stamps, and properties or clocks, but no content: blocks that hold none of these
    are left out, and a paragraph leaves its code spans alone."""
    rests = {id(b): _undefined(b[2], labels) for s in sections for b in s.blocks if b[1] == "text" and b[2][0].lstrip(" ").startswith("[")}
    out = []
    for s in sections:
        blocks = []
        for b in s.blocks:
            at, kind, lines, info = b
            if kind == "fence" and info == "org-properties":
                if properties:
                    blocks.append((at, kind, "\n".join(lines), info, None))
                continue
            text = rests.get(id(b))
            text = "\n".join(lines) if text is None else text
            if not _DATED.search(text) and not (clocks and "CLOCK:" in text):
                continue
            if kind != "text":
                blocks.append((at, kind, text, info, None))
            elif "`" in text:
                text = text.strip(" \t\n")
                codes = [code_text(c) for c in _CODE.findall(text)] if _CODES.fullmatch(text) else shown(text, labels)[2]
                blocks.append((at, kind, "", None, codes))
        out.append((s, shown(s.title, labels)[0], blocks))
    return out


#: White space of any script, and fixed values: the forms of stamps that open a text (see ``stamps``).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CREATES, _PLANS = (re.compile(p.replace("(?U)", "").replace(r"\s", f"[{_WHITE}]")) for p in (stamps.CREATED, stamps.PLANNING))
_INDENT, _TICKED = re.compile(r"^(?: {4}| {0,3}\t)", re.M), re.compile(r"(`+)(.+?)\1", re.S)
_ANGLES, _SQUARES = re.compile(r">--?-?<"), re.compile(r"\]--?-?\[")


def _written(kind: str, body: str, codes: list[str] | None) -> list[str]:
    """The texts of a block that may hold stamps or clocks: a paragraph's code spans, or a code block as a whole."""
    if kind == "text":
        return codes
    text = (_INDENT.sub("", body) if kind == "indented" else body).strip(_WHITE)
    m = _TICKED.fullmatch(text) if text.startswith("`") else None
    return [m[2] if m else text]


def _created(text: str) -> str | None:
    m = _CREATES.match(text) if "CREATED:" in text else None
    return m and f"CREATED: [{m[1]}]"


def _planned(text: str) -> str | None:
    """The canonical stamp that a text begins with: a keyword takes one stamp, without it a range has two."""
    m = None if text.startswith("CREATED:") else _PLANS.match(text)
    if not m:
        return None
    found = m[0].lstrip(_WHITE)
    if found[0] == "<":
        return _ANGLES.sub(">--<", found)
    if found[0] == "[":
        return _SQUARES.sub("]--[", found)
    end = "]" if found[0] == "C" else ">"
    return found[: found.index(end) + 1]


def _pairs(bodies: list[str]) -> list[tuple[str, str]] | None:
    """Keys and values of property blocks: split at the first colon, trimmed; the last of equal keys wins."""
    found = {}
    for body in bodies:
        for line in body.split("\n"):
            key, colon, value = line.partition(":")
            if colon and (key := key.strip(_WHITE)):
                found[key] = value.strip(_WHITE)
    return sorted(found.items()) or None


def _fields(blocks: list[tuple]) -> tuple:
    """(created, timestamp, properties, property blocks, texts with clocks) of a section's blocks: the last block that
    has a stamp gives it, by the first of its texts that opens with one."""
    created = planned = None
    own, clocks = [], []
    for at, kind, body, info, codes in blocks:
        if info == "org-properties":
            own.append((at, body))
            continue
        new = plan = None
        for text in _written(kind, body, codes):
            if "CLOCK:" in text:
                clocks.append(text)
                if text.startswith("CLOCK:"):
                    continue
            if "<" in text or "[" in text:
                if not text.isascii():
                    for name, english in stamps.WEEKDAYS:
                        text = text.replace(name, english)
                new = _created(text) if new is None else new
                plan = _planned(text) if plan is None else plan
        created, planned = (created if new is None else new), (planned if plan is None else plan)
    return created, planned, _pairs([body for _, body in own]), own, clocks


_BLOCK = pa.struct([("at", pa.int32()), ("kind", pa.string()), ("body", pa.string()), ("info", pa.string()), ("codes", pa.list_(pa.string()))])
SECTIONS = "root string, file string, line int, level int, title string, written string, blocks array<struct<at:int,kind:string,body:string,info:string,codes:array<string>>>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (root, file, section, shown title, blocks)."""
    blocks = [b for *_, own in rows for b in own]
    columns = list(zip(*blocks)) or [()] * 5
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK)], fields=list(_BLOCK))
    offsets = [0]
    for *_, own in rows:
        offsets.append(offsets[-1] + len(own))
    out = [pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)]
    out += [pa.array([getattr(r[2], name) for r in rows], pa.int32()) for name in ("line", "level")]
    out += [pa.array([r[3] for r in rows], pa.string()), pa.array([r[2].written for r in rows], pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
    return pa.RecordBatch.from_arrays(out, ["root", "file", "line", "level", "title", "written", "blocks"])


def sections(notes: DataFrame, cap: int = 0, parts: tuple[str, ...] = ("content",)) -> DataFrame:
    """``notes(root, file, text)`` -> ``(root, file, line, level, title, written, blocks)``, one row a heading.

    ``title`` and the ``body`` of a paragraph are without marks; ``codes`` are a paragraph's code spans. ``written`` is
    the heading's line, null for an underlined one. A null text has no sections. See ``sections_of`` for the cap. Without
    ``content`` among the parts only blocks that hold stamps leave, and ``properties`` and ``clocks`` where they are named.
    """
    whole, properties, clocks = ("content" in parts, "properties" in parts, "clocks" in parts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for root, file, text in zip(*batch.columns):
                text, labels = text.as_py() or "", set()
                name = (root.as_py(), file.as_py())
                found = sections_of(text, labels, cap)
                rows += [(*name, *r) for r in (_resolved(found, labels) if whole else _marked(found, labels, properties, clocks))]
                size += len(text)
                if rows and (len(rows) >= 10_000 or size >= 1 << 24):
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    return notes.select("root", "file", "text").mapInArrow(run, SECTIONS)


FIELDS = "root string, file string, line int, level int, title string, created string, timestamp string, properties map<string,string>, property_blocks array<struct<at:int,body:string>>, clock_texts array<string>"
_FIELD_TYPES = [
    *[pa.string()] * 2, *[pa.int32()] * 2, *[pa.string()] * 3, pa.map_(pa.string(), pa.string()), pa.list_(pa.struct([("at", pa.int32()), ("body", pa.string())])), pa.list_(pa.string()),
]


def fields(notes: DataFrame, cap: int = 0, parts: tuple[str, ...] = ("properties",)) -> DataFrame:
    """``sections`` for those who read no content: instead of blocks the stamps that open their texts, and where the parts
    name them ``properties`` with ``property_blocks`` (``pairs``: without) and the texts that hold ``clocks``."""
    blocks, clocks = "properties" in parts, "clocks" in parts
    pairs = blocks or "pairs" in parts

    def rows(root: str, file: str, text: str) -> Iterator[tuple]:
        labels: set[str] = set()
        for s, title, found in _marked(sections_of(text, labels, cap), labels, pairs, clocks):
            created, planned, own, bodies, clocked = _fields(found)
            yield root, file, s.line, s.level, title, created, planned, own, [{"at": a, "body": b} for a, b in bodies] if blocks else None, clocked if clocks else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.strip().split(" ")[0] for c in FIELDS.replace("map<string,string>", "map").split(", ")]

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*held), _FIELD_TYPES)], names)

        for batch in batches:
            held, size = [], 0
            for k in range(batch.num_rows):
                root, file, text = (column[k].as_py() for column in batch.columns)
                held += rows(root, file, text or "")
                size += len(text or "")
                if held and (len(held) >= 10_000 or size >= 1 << 24):
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    return notes.select("root", "file", "text").mapInArrow(run, FIELDS)


def heading_lines(notes: DataFrame) -> DataFrame:
    """``notes(root, file, text)`` -> ``(root, file, line, written)``: the lines of headings that are not underlined, as
    they are written. Blocks are followed, but neither kept nor are their marks resolved."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for root, file, text in zip(*(batch.column(k)[at : at + 1000].to_pylist() for k in range(3))):
                    rows += [(root, file, s.line, s.written) for s in sections_of(text or "") if s.written is not None]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], ["root", "file", "line", "written"])

    return notes.select("root", "file", "text").mapInArrow(run, "root string, file string, line int, written string")


def displayed(fragment: str) -> str:
    """A fragment as it is shown: the text of its headings and paragraphs, also of those in lists and quotes, one behind
    the other; code blocks and HTML show nothing."""
    labels, texts = set(), []
    nest = _Containers(labels, texts)
    for line in _LINE_END.split(fragment):
        if not nest.takes(line):
            nest.begin(line)
    nest.close()
    return "".join(shown(t.strip(" \t\n"), labels)[0] for t in texts).strip()


def display_text(fragment: Column) -> Column:
    """``displayed`` of a column; null for null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else displayed(t))

    return of(fragment)
