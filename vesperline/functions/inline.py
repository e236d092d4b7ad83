"""Inline marks of one heading or paragraph: what shows of it, and its code spans.

Which star closes which depends on a stack of all marks before it, so this is a fold over the characters of one text, like
the fold over the lines of a note in ``operators.blocks``. Texts without a mark do not get here.
"""

from __future__ import annotations

import re
import unicodedata
from html.entities import html5

_ANY = re.compile(r"[`\[\]*_~\\&<\n]")
_PLAIN = re.compile(r"[^`!\[\]*_~\\&<\n]+|!(?!\[)")
_RUN = re.compile(r"`+|\*+|_+|~+")
_TICKS = re.compile("`+")
#: What text may hold besides plain text so that its marks need no stack: code spans of single backticks, links without a
#: title, and runs of one or two that open behind a space, hold words alone and close before one.
_CODE, _LINK = r"(?<!`)`[^`]+`(?!`)", r"""\[[^`!\[\]*_~\\&<\n]*\]\([^\s()\[\]<>\\`"']+\)"""
_WORDS = r"[A-Za-z0-9](?:[^`!\[\]*_~\\&<\n]*[A-Za-z0-9])?"
_EMPHASIS = "|".join(rf"(?<![^\s(]){m}{_WORDS}{m}(?=[\s.,;:?)]|$)" for m in (r"\*", r"\*\*", "_", "__", "~~"))
_UNNESTED = rf"[^`!\[\]*_~\\&<]+|!(?!\[)|{_CODE}|{_LINK}|{_EMPHASIS}"
#: The same without and with brackets that are text where a note defines no links.
_UNNESTED, _BRACKETED = re.compile(rf"(?:{_UNNESTED})*+"), re.compile(rf"(?:{_UNNESTED}|\[[^`!\[\]*_~\\&<\n]*\](?![(\[]))*+")
_SPAN = re.compile(r"`([^`]+)`")
_UNNESTED_MARK = re.compile(r"\[([^\]]*)\]\([^)]*\)|[*_~]")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]*));")
_BREAK = re.compile(r"[ \t]*\n[ \t]*")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
OPEN_TAG, CLOSE_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>", r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
_TITLE = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))"""
_NESTED = r"\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\)"
_TARGET = re.compile(rf"\(\s*(?:<(?:[^<>\n\\]|\\.)*>|(?:[^\s()\\<]|\\.|{_NESTED})(?:[^\s()\\]|\\.|{_NESTED})*)?(?:\s+{_TITLE})?\s*\)", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
DEFINITION = re.compile(rf" {{0,3}}\[((?:[^\[\]\\]|\\.){{1,999}})\]:[ \t]*\n?[ \t]*(?:<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*){_TITLE})?[ \t]*(?:\n|$)", re.S)


def label_of(text: str) -> str:
    """A reference label as it is compared: case and runs of white space do not count."""
    return " ".join(text.split()).casefold()


def definitions(paragraph: str) -> tuple[list[str], str]:
    """(labels, the rest) of the link definitions that a paragraph begins with."""
    labels, at = [], 0
    while (m := DEFINITION.match(paragraph, at)) and m[1].strip():
        labels.append(label_of(m[1]))
        at = m.end()
    return labels, paragraph[at:]


def _space(c: str) -> bool:
    return c == "" or c.isspace()


def _mark(c: str) -> bool:
    return c != "" and unicodedata.category(c)[0] in "PS"


class _Run:
    """A run of delimiters: what is left of it, and whether it can open and close."""

    __slots__ = ("node", "char", "size", "left", "opens", "closes")

    def __init__(self, node: int, char: str, size: int, before: str, after: str):
        self.node, self.char, self.size, self.left = node, char, size, size
        ahead = not _space(after) and (not _mark(after) or _space(before) or _mark(before))
        behind = not _space(before) and (not _mark(before) or _space(after) or _mark(after))
        self.opens, self.closes = ahead, behind
        if char == "_":
            self.opens, self.closes = ahead and (not behind or _mark(before)), behind and (not ahead or _mark(after))


def _pair(runs: list[_Run], wraps: list[tuple[int, int]]) -> None:
    """Match closing runs with the nearest opening ones; what they span goes to ``wraps``."""
    openers: dict[str, list[_Run]] = {"*": [], "_": [], "~": []}
    order: dict[int, int] = {id(r): k for k, r in enumerate(runs)}
    bottom: dict[tuple, int] = {}
    for k, closer in enumerate(runs):
        while closer.closes and closer.left:
            kind = (closer.char, closer.opens, closer.size % 3)
            stack, found = openers[closer.char], None
            for i in range(len(stack) - 1, -1, -1):
                o = stack[i]
                if order[id(o)] < bottom.get(kind, 0):
                    break
                odd = (o.closes or closer.opens) and (o.size + closer.size) % 3 == 0 and (o.size % 3 or closer.size % 3)
                if o.left and (o.left == closer.left if o.char == "~" else not odd):
                    found = i
                    break
            if found is None:
                bottom[kind] = k
                break
            o = stack[found]
            used = 2 if min(o.left, closer.left) >= 2 else 1
            for name in openers:  # marks in between stay text
                s = openers[name]
                while s and order[id(s[-1])] > order[id(o)]:
                    s.pop()
            wraps.append((o.node, closer.node))
            o.left -= used
            closer.left -= used
            if not o.left:
                stack.pop()
        if closer.opens and closer.left:
            openers[closer.char].append(closer)


def shown(text: str, labels: frozenset[str] | set[str] = frozenset()) -> tuple[str, str, list[str]]:
    """(text with inline code kept, text without it, code spans that stand in nothing else) of one heading or paragraph.

    ``labels`` are the link definitions of the note. Emphasis, strike marks, links and autolinks give their text; images,
    inline HTML and line ends give nothing; escapes and entities are what they stand for.
    """
    if not _ANY.search(text):
        return text, text, []
    return _unnested(text) if (_UNNESTED if labels else _BRACKETED).fullmatch(text) else _folded(text, labels)


def _unnested(text: str) -> tuple[str, str, list[str]]:
    """``shown`` of text whose marks stand side by side: most headings, paragraphs and lines that carry stamps."""
    parts = _SPAN.split(text)
    codes = parts[1::2] = [code_text(c) for c in parts[1::2]]
    parts[::2] = [_UNNESTED_MARK.sub(r"\1", t) for t in parts[::2]]
    if "\n" in text:
        parts[::2] = [_BREAK.sub("", t) for t in parts[::2]]
    return "".join(parts), "".join(parts[::2]), codes


def _folded(text: str, labels: frozenset[str] | set[str]) -> tuple[str, str, list[str]]:
    """``shown`` by the stack of all marks."""
    ticks: dict[int, list[int]] = {}
    for m in _TICKS.finditer(text):
        ticks.setdefault(len(m[0]), []).append(m.start())
    for places in ticks.values():
        places.reverse()  # the next one is the last
    nodes: list[tuple[str, str]] = []  # (kind, text)
    runs: list[_Run] = []  # those that no link has closed in
    every: list[_Run] = []
    brackets: list[tuple[int, int, int, bool]] = []  # node, runs before it, place behind it, image
    inactive = 0  # brackets below this cannot open a link
    wraps: list[tuple[int, int]] = []
    images: list[tuple[int, int]] = []
    i, end = 0, len(text)
    while i < end:
        if m := _PLAIN.match(text, i):
            nodes.append(("t", m[0]))
            i = m.end()
            continue
        c = text[i]
        if c == "\n" or c == "\\" and text[i + 1 : i + 2] == "\n":
            i = _BREAK.match(text, i + (c == "\\")).end()
            if nodes and nodes[-1][0] == "t":
                nodes[-1] = ("t", nodes[-1][1].rstrip(" \t"))
        elif c in "`*_~":
            m = _RUN.match(text, i)
            i = m.end()
            if c == "`":
                places = ticks.get(len(m[0]), [])
                while places and places[-1] < i:
                    places.pop()
                if places:
                    nodes.append(("c", code_text(text[i : places[-1]])))
                    i = places.pop() + len(m[0])
                else:
                    nodes.append(("t", m[0]))
            elif c == "~" and len(m[0]) != 2:
                nodes.append(("t", m[0]))
            else:
                runs.append(_Run(len(nodes), c, len(m[0]), text[m.start() - 1 : m.start()], text[i : i + 1]))
                every.append(runs[-1])
                nodes.append(("d", m[0]))
        elif c == "\\":
            m = _ESCAPE.match(text, i)
            nodes.append(("t", m[1] if m else c))
            i += 2 if m else 1
        elif c == "&":
            m = _ENTITY.match(text, i)
            value = m and _entity(m)
            nodes.append(("t", value or c))
            i = m.end() if value else i + 1
        elif c == "<":
            m = _AUTOLINK.match(text, i) or _HTML.match(text, i)
            if m and m.re is _AUTOLINK:
                nodes.append(("t", m[1]))
            elif not m:
                nodes.append(("t", c))
            i = m.end() if m else i + 1
        elif c == "[" or c == "!":
            nodes.append(("t", "![" if c == "!" else "["))
            i += len(nodes[-1][1])
            brackets.append((len(nodes) - 1, len(runs), i, c == "!"))
        else:  # a closing bracket
            i += 1
            if not brackets:
                nodes.append(("t", c))
                continue
            node, n_runs, at, image = brackets.pop()
            live, inactive = image or len(brackets) >= inactive, min(inactive, len(brackets))
            stop = _tail(text, at, i, labels) if live else None
            if stop is None:
                nodes.append(("t", c))
                continue
            _pair(runs[n_runs:], wraps)
            del runs[n_runs:]
            nodes[node] = ("t", "")
            nodes.append(("t", ""))
            (images if image else wraps).append((node, len(nodes) - 1))
            if not image:
                inactive = len(brackets)  # a link holds no link
            i = stop
    _pair(runs, wraps)
    return _joined(nodes, {r.node: r.char * r.left for r in every}, wraps, images)


def code_text(code: str) -> str:
    """What a code span holds: line ends are spaces, and one space at either end goes."""
    code = code.replace("\n", " ")
    return code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip(" ") else code


def _entity(m: re.Match) -> str | None:
    if m[3]:
        return html5.get(m[3] + ";")
    code = int(m[1], 16) if m[1] else int(m[2])
    return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _tail(text: str, at: int, i: int, labels) -> int | None:
    """Where a link ends whose text is ``text[at:i - 1]``; None where it is none."""
    if text[i : i + 1] == "(" and (m := _TARGET.match(text, i)):
        return m.end()
    m = _LABEL.match(text, i)
    if m and m[1].strip():
        return m.end() if label_of(m[1]) in labels else None
    own = text[at : i - 1]
    if labels and len(own) < 1000 and _LABEL.fullmatch(f"[{own}]") and label_of(own) in labels:
        return m.end() if m else i
    return None


def _joined(nodes: list, rest: dict[int, str], wraps: list, images: list) -> tuple[str, str, list[str]]:
    steps = [[0] * (len(nodes) + 1), [0] * (len(nodes) + 1)]
    for step, spans in zip(steps, (wraps, images)):
        for a, b in spans:
            step[a] += 1
            step[b] -= 1
    kept, dropped, codes = [], [], []
    wrapped = hidden = 0
    for k, (kind, t) in enumerate(nodes):
        wrapped += steps[0][k]
        hidden += steps[1][k]
        if hidden:
            continue
        if kind == "c":
            kept.append(t)
            if not wrapped:
                codes.append(t)
            continue
        t = rest.get(k, "") if kind == "d" else t
        kept.append(t)
        dropped.append(t)
    return "".join(kept), "".join(dropped), codes
