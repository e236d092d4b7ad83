"""Blocks and marks of notes, case by case."""

import time

import pytest

from vesperline.functions.inline import definitions, shown
from vesperline.operators.blocks import _marked, _resolved, sections_of


def read(text, cap=0):
    labels = set()
    return [(s.line, title, [(at, kind, body) for at, kind, body, *_ in blocks]) for s, title, blocks in _resolved(sections_of(text, labels, cap), labels)]


@pytest.mark.parametrize("text,found", [
    ("# A\n- point\n  ```org-properties\n  K: v\n  ```\n- # B\n\nback\n", [(1, "A", [(8, "text", "back")])]),
    ("# A\n> # B\n> text\nlazy\n===\n# C\n", [(1, "A", []), (6, "C", [])]),  # a lazy row of equals signs is text
    ("# A\n> text\n---\nnext\n", [(1, "A", [(4, "text", "next")])]),
    ("# A\n> ```\n# B\n", [(1, "A", []), (3, "B", [])]),  # a fence in a quote ends with it
    ("# A\n1) x\n\n   # B\n\n  out\n", [(1, "A", [(6, "text", "out")])]),
    ("# A\n-\n\n  out\n", [(1, "A", [(4, "text", "out")])]),  # an empty item ends at a blank line
    ("# A\n-\n  in\n", [(1, "A", [])]),
    ("# A\ntext\n14. goes on\n*\n1. item\n", [(1, "A", [(2, "text", "text14. goes on*")])]),
    ("# A\n-     code\n\n      more\n x\n", [(1, "A", [(5, "text", "x")])]),
    ("# A\n* * *\n*\tx\n\n\ty\n", [(1, "A", [])]),
    ("# A\n<pre>\n\n# B\n</pre> end\n# C\n", [(1, "A", []), (6, "C", [])]),
    ("# A\n<section>\n# B\n\n# C\n", [(1, "A", []), (5, "C", [])]),
    ("# A\n<my-tag>\n# B\n\ntext\n<my-tag>\n", [(1, "A", [(5, "text", "text")])]),
    ("# A\n<my-tag> x\n# B\n", [(1, "A", [(2, "text", " x")]), (3, "B", [])]),
    ("# A\n<!-- one line -->\n# B\n<?php\n\n# C ?>\n<![CDATA[\n# D\n]]>\n<!DOC\n# E>\n", [(1, "A", []), (3, "B", [])]),
    ("# A\n    a\n\n\n    b\n\nc\n", [(1, "A", [(2, "indented", "    a\n\n\n    b"), (7, "text", "c")])]),
    ("# A\n[x]: /y\n# [t][X] [x]\n", [(1, "A", []), (3, "t x", [])]),
    ("# A\n[x]: /y 'z'\n---\n# [x]\n", [(1, "A", []), (4, "x", [])]),  # definitions alone make no heading
    ("- [x]: /y\n\n# [x] [z]\n", [(3, "x [z]", [])]),
])
def test_what_holds_what(text, found):
    assert read(text) == found


def test_a_cap_stops_a_note_behind_its_tasks():
    text = "".join(f"# TODO t{i}\n\nbody {i}\n\n# plain {i}\n" for i in range(50))
    assert [t for _, t, _ in read(text, 3)] == ["TODO t0", "plain 0", "TODO t1", "plain 1", "TODO t2", "plain 2"]
    assert len(read(text, 100)) == 100


@pytest.mark.parametrize("text,kept", [
    ("a *b* _c_ **d** __e__", "a b c d e"), ("2*3*4 a_b_c", "234 a_b_c"), ("*a*b ** c **", "ab ** c **"), ("**a*", "*a"), ("*(*a*)*", "(a)"), ("_a*b_c*", "_ab_c"),
    ("[a](b)[c]( <d e>\n'f' )", "ac"), ("[a](b c) [d](e(f)g)", "[a](b c) d"), ("![a [b](c)](d)e", "e"), ("[x ![y](z)](w)", "x "), (r"\[a](b) \\ \q", "[a](b) \\ \\q"),
    ("<a@b.example> <http:x y> <q r='s'/>t</q >", "a@b.example <http:x y> t"), ("&quot;&ouml;&#0;&#xD800;&#150;&amp;lt;", "\"ö��\x96&lt;"), ("a `` b ` c", "a `` b ` c"),
    ("`a\nb` c  \n  d\\\ne", "a b cde"), ("` a `` ` `  `", "a ``   "), ("~~a~~ ~b~ ~~~c~~~", "a ~b~ ~~~c~~~"), ("***a** b*", "a b"), ("[*a](b)*", "*a*"), ("*[a*](b)", "*a*"),
])
def test_what_shows(text, kept):
    assert shown(text)[0] == kept


def test_code_spans_count_outside_of_other_marks_only():
    assert shown("`a` *`b`* [`c`](d) ![`e`](f) **g `h`** `i`") == ("a b c  g h i", "    g  ", ["a", "i"])
    assert shown("[`a`]", {"x"})[2] == ["a"] and shown("[`a`]", {"`a`"})[2] == []


def test_definitions_begin_a_paragraph():
    assert definitions("[A  b]: <x y> (t)\n[c]:\n /d\ntext [e]: f") == (["a b", "c"], "text [e]: f")
    assert definitions("[a]: /u 'open\nrest") == ([], "[a]: /u 'open\nrest") and definitions("[a]: /u\n'b'\nc")[1] == "c"


@pytest.mark.parametrize("part", ["*a ", "[", "[a](b", "`" * 3 + "x`", "**a*", "<a ", "![", "_a_ *", "\\", "&", "[a][", "~~a "])
def test_long_texts_of_open_marks_take_their_time_in_proportion(part):
    spent = []
    for n in (4_000, 16_000):
        began = time.perf_counter()
        shown(part * n)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 12 * max(spent[0], 0.02)


def test_deep_containers_end():
    text = "# A\n" + "> " * 2000 + "x\n" + "\n# B\n" + "- " * 500 + "y\n# C\n"
    assert [t for _, t, _ in read(text)] == ["A", "B", "C"]


def test_the_short_way_for_code_alone_shows_the_same(monkeypatch):
    import random
    import re

    from vesperline.functions import inline

    rng = random.Random(2)
    texts = ["".join(rng.choice("a`` \n!b<[") for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    fast = [shown(t) for t in texts]
    for quick in ("_UNNESTED", "_BRACKETED"):
        monkeypatch.setattr(inline, quick, re.compile("(?!)x"))
    assert fast == [shown(t) for t in texts]


@pytest.mark.parametrize("fragment,text", [
    ("", ""), ("# *A* `b`", "A b"), ("> - # x\n>   y\n> z\n\nw", "xyzw"), ("    code", ""), ("- a\n\n  b\n- [r]\n\n> [R]: /u", "abr"), ("```\nx\n```\ny", "y"), ("a\n===\nb", "ab"), ("<p>\nx\n\ny", "y"),
])
def test_fragments_as_shown(fragment, text):
    from vesperline.operators.blocks import displayed

    assert displayed(fragment) == text


def test_marks_side_by_side_read_as_by_the_stack_of_all_marks():
    import random

    from vesperline.functions import inline

    rng, met = random.Random(11), 0
    pieces = ["*", "**", "_", "__", "~~", "`", "``", "[tea](pot)", "[big cup](h:/s_u*g)", "[#B]", "[", "]", "](", ")", "(", "!", "![", "\n", " ", " ", "  ",
              "milk", "s1", ".", ",", "*hot*", "**very hot**", "_mild_", "~~cold~~", "`brew`", "` leaf `", "й", "—", '"']
    for _ in range(40_000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 8))).strip(" \t\n")
        for quick, labels in ((inline._UNNESTED, frozenset({"tea", "big cup", "#b"})), (inline._BRACKETED, frozenset())):
            if quick.fullmatch(text):
                met += 1
                assert inline._unnested(text) == inline._folded(text, labels), text
    assert met > 5_000


def test_stamps_and_properties_leave_alone():
    """Without content only what may hold a stamp or properties leaves, with the code spans that all marks give."""
    text = "## TODO *a* `b`\n`DEADLINE: <2024-01-02 Tue>`\n`x`\n\nplain [c](d`[2024-01-01]`) `e`\n\n    [2024-03-04]\n\n```\ncode\n```\n```org-properties\nID: 1\n```\n`CLOCK: [2024-01-01 09:00]`\n"
    labels = set()
    found = sections_of(text, labels)
    [(_, title, all_blocks)], [(_, bare_title, some)] = _resolved(found, labels), _marked(found, labels, True, False)
    assert title == bare_title == "TODO a b"
    codes = {b[0]: b[4] for b in all_blocks if b[1] == "text"}
    assert [(b[0], b[1]) for b in some] == [(2, "text"), (5, "text"), (7, "indented"), (12, "fence"), (15, "text")]
    assert all(b[2] == "" and b[4] == codes[b[0]] for b in some if b[1] == "text")
    assert [b for b in some if b[1] != "text"] == [b for b in all_blocks if b[0] in (7, 12)]
    assert [b[1] for b in _marked(found, labels, False, False)[0][2]] == ["text", "text", "indented", "text"]
