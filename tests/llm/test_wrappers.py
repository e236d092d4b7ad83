import os
import random
import re

import pytest

from vesperline.llm import wrappers


def tree_of(text):
    """'a(b c(d))' as a tree."""
    tree, stack, last = wrappers.Tree(), [], None
    for token in re.findall(r"[a-z.]+|[()]", text):
        if token == "(":
            stack.append(last)
        elif token == ")":
            stack.pop()
        else:
            last = tree.add(token)
            if stack:
                tree.kids[stack[-1]].append(last)
    return tree


def shape(tree, node=0):
    kids = " ".join(shape(tree, k) for k in tree.kids[node])
    return tree.labels[node] + (f"({kids})" if kids else "")


def most_shared(a, b, x=0, y=0):
    """All order-keeping pairings of kids, without memory."""
    if a.labels[x] != b.labels[y]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + most_shared(a, b, x[0], y[0]))

    return 1 + best(a.kids[x], b.kids[y])


def random_tree(rng, tree=None, depth=3):
    tree = tree or wrappers.Tree()
    node = tree.add(rng.choice("ab") if depth < 3 else "r")
    if depth:
        tree.kids[node] = [random_tree(rng, tree, depth - 1) for _ in range(rng.randrange(3))]
    return node if depth < 3 else tree


def test_tree_matching_equals_all_pairings():
    rng = random.Random(1)
    for _ in range(200):
        a, b = random_tree(rng), random_tree(rng)
        assert wrappers.matched(a, b) == most_shared(a, b)


def test_alignment_keeps_every_page_node_in_order():
    template = tree_of("html(nav div article(h p) footer)")
    page = tree_of("html(nav article(h p q) aside footer)")
    pairs = wrappers.align(template, page)
    assert shape(template) == "html(nav div article(h p q) aside footer)"
    assert len(pairs) == 8 and all(page.labels[p] == template.labels[t] for p, t in pairs.items())
    assert shape(wrappers.Tree.of(template.text())) == shape(template)
    other = tree_of("html(x nav)")
    assert {other.labels[p] for p in wrappers.align(template, other, grow=False)} == {"html", "nav"}
    assert shape(template) == "html(nav div article(h p q) aside footer)"


def test_a_merged_template_leaves_rare_nodes_out():
    common, odd = tree_of("html(nav article(p))").text(), [tree_of(f"html(nav article(p) div.{c}{d})").text() for c in "abcdefghij" for d in "abcdefghij"]
    assert shape(wrappers.Tree.of(wrappers.merged([common, *odd]))) == "html(nav article(p))"


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li>'
    '<li><a href="/x">X</a></li></ul></nav><!-- c <p>no</p> --><div class="ad">Buy {n} &amp; more</div><article><h1>Head {n}</h1><p><b>First  &eacute;\n{n}<br>'
    '<p>Second &lt;tag&gt; a &amp; b {n} {long}</p><form>Mail? <input></form><div class="reader-comments"><p>Nice {n}</p></div></article>'
    '<aside>Side {n}</aside><footer>&copy; {n}</footer></body></html>'
)
LONG = "of running text that goes on for a while " * 5


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    return {r.page_id: (r.text, r.n_chars) for r in wrappers.main_text(df, **more).collect()}


@pytest.mark.parametrize("most_broadcast", [1 << 20, -1])
def test_articles_without_furniture(spark, most_broadcast):
    rows = [(i, f"http://h{i % 2}.example.net/{i}", PAGE.format(n=i, long=LONG)) for i in range(8)]
    rows += [(20, "http://h0.example.net/cut", PAGE.format(n=20, long=LONG)[:520] + "<p"), (21, None, None), (22, "x", ""), (23, "http://h1.example.net/", "<nav>only</nav>")]
    found = run(spark, rows, most_broadcast=most_broadcast)
    for i in range(8):
        want = f"Head {i}\nFirst é {i}\nSecond <tag> a & b {i} {LONG}".strip()
        assert found[i] == (want, len(want))
    assert found[20][0].startswith("Head 20\nFirst é 20\nSecond <tag> a & b 20 of running") and not found[20][0].endswith("<p")
    assert found[21] == found[22] == found[23] == ("", 0)
    assert run(spark, []) == {}


def test_unmarked_pages_use_what_varies(spark):
    page = '<body><div class="top"><a href=/>Home</a> <a href=/b>B</a></div><div class="x1"><h2>Same on all</h2><p>{a}</p><p>{b}</p></div><div class="end">All rights</div></body>'
    rows = [(i, "https://u.example.org/p", page.format(a=f"Text {i} " + LONG, b=f"More {i} {LONG}")) for i in range(6)]
    found = run(spark, rows)
    for i in range(6):
        assert found[i][0] == f"Text {i} {LONG}".strip() + "\n" + f"More {i} {LONG}".strip()


def test_copies_on_one_host_keep_their_article(spark):
    rows = [(i, "http://copies.example.net/", PAGE.format(n=1, long=LONG)) for i in range(5)]
    assert {t for t, _ in run(spark, rows).values()} == {f"Head 1\nFirst é 1\nSecond <tag> a & b 1 {LONG}".strip()}


def test_odd_markup_does_not_break_the_parser():
    rng = random.Random(4)
    bits = ["<p>", "</p>", "<div class='a", '"', "'", ">", "<", "&am", "&#x41;", "<!--", "-->", "<script>", "</script", "text", " ", "<b>", "</b>", "<li>", "</ul>", "<br/>", "<a href=x>", "</a>", "<table><tr><td>"]
    for _ in range(2000):
        tree, blocks = wrappers.parse("".join(rng.choice(bits) for _ in range(rng.randrange(25))))
        size = len(wrappers.Tree.of(tree.text()).labels)
        assert all(0 <= n < size and t == t.strip() != "" and 0 <= k <= len(t) for n, t, k in blocks)


def test_minor_layouts_of_a_host_keep_their_text(spark):
    page = '<body><nav>Home</nav><article class="post category-{c}" id="{slug}"><p>{t}</p></article></body>'
    rows = [(i, "http://big.example.net/", page.format(c="news", slug="a", t=f"Text {i} {LONG * 9}")) for i in range(12)]
    rows += [(20, "http://big.example.net/", page.format(c="misc", slug="b-rare-slug", t="A short one of another category"))]
    rows += [(21, "http://big.example.net/", f"<body><nav>Home</nav><div class=old><p>An unmarked page {LONG}</p></div></body>")]
    found = run(spark, rows)
    assert found[20][0] == "A short one of another category" and found[21][0] == f"An unmarked page {LONG}".strip()
    assert all(found[i][0] == f"Text {i} {LONG * 9}".strip() for i in range(12))


def scrambled(page):
    """Every class and id name replaced by one that says nothing."""
    return re.sub(r'(class|id)="([^"]*)"', lambda m: f'{m[1]}="' + " ".join("x" + "".join(chr(97 + ord(c) % 7) for c in w) for w in m[2].split()) + '"', page)


def test_names_are_not_needed_where_slots_tell(spark):
    page = (
        '<body><div class="top menu"><p>Site of things</p><a href=/>Home</a></div><div class="ad">Buy {ad}</div><div class="story"><h1>Head {n}</h1><p>Text {n} {long}</p>'
        '<p>More {n}</p></div><div class="sidebar"><p>Always here, a line that all pages of this site have</p></div><div class="footer">Rights</div></body>'
    )
    pages = [page.format(n=i, ad=i % 3, long=LONG) for i in range(30)]
    named = run(spark, [(i, "http://n.example.net/", p) for i, p in enumerate(pages)])
    blank = run(spark, [(i, "http://n.example.net/", scrambled(p)) for i, p in enumerate(pages)])
    assert named == blank and named[3][0] == f"Head 3\nText 3 {LONG.strip()}\nMore 3"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_scrambled_names_give_the_given_pages_the_same_text(spark):
    import pyarrow.parquet as pq

    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    assert run(spark, [(i, u, scrambled(h or "")) for i, u, h in rows]) == run(spark, rows)


def test_very_deep_and_very_wide_pages(spark):
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    wide = "<body>" + "".join(f"<p>p {i}</p><div class=c{'abc'[i % 3]}>d {i}</div>" for i in range(3000))
    found = run(spark, [(1, "http://d.example.net/", deep), (2, "http://d.example.net/", deep.replace("<p>", "<b>" * 3000)), (3, "http://w.example.net/", wide)])
    assert found[1][0] == "deep text" and found[2][0] == "deep text" and found[3][0].count("\n") == 5999


def test_many_layouts_of_a_host_merge_in_rounds(spark):
    page = '<body><nav>Home</nav><div class="{a} {b}"><h1>Head {n}</h1><p>Text {n} {long}</p></div><div class="{b}">note</div></body>'
    rows = [(i, "http://big.example.net/", page.format(n=i, a=f"{chr(97 + i % 26)}q", b=f"{chr(97 + i // 26)}z", long=LONG)) for i in range(600)]
    found = run(spark, rows)
    assert all(found[i][0] == f"Head {i}\nText {i} {LONG}".strip() for i in range(600))
