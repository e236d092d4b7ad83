"""Main text of web pages by wrapper induction: pages of a host are aligned by simple tree matching."""

from __future__ import annotations

import hashlib
import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperline.llm._spark import as_table

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")

_RAW = {"script", "style", "noscript", "template", "iframe", "noframes", "object", "svg", "math", "canvas", "textarea", "select", "title", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_LINE_BREAKS = {"br"}
#: An opening tag ends these open elements, up to the nearest of the borders.
_ENDS_OPEN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BORDERS = {"ul", "ol", "dl", "table", "article", "section", "main", "aside", "nav", "footer", "header", "body", "form", "div", "blockquote"}

_FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_FURNITURE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie",
    "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip",
    "social", "sponsor", "sponsored", "subscribe", "tags", "toc", "toolbar", "widget",
}
_CONTENT_TAGS = {"article", "main"}
_CONTENT_NAMES = {"articlebody", "article", "main", "content", "post", "entry", "story"}


_PARAGRAPHS = {"p", "pre", "blockquote", "ul", "ol", "dl", "li", "dt", "dd", "table", "tr", "td", "th", "figure", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"}
_DEEPEST = 512  # as in browsers: elements below are taken as their parent's siblings
_WIDEST = 256  # beyond, kids of one label are one node wherever they stand


class Tree:
    """Block-level elements in page order, by number. ``labels``: tag and class, id and role words; ``kids``: numbers."""

    def __init__(self) -> None:
        self.labels: list[str] = []
        self.kids: list[list[int]] = []
        self.support: list[int] = []  # layouts that have the node

    def add(self, label: str, support: int = 1) -> int:
        self.labels.append(label)
        self.kids.append([])
        self.support.append(support)
        return len(self.labels) - 1

    def walk(self) -> list[tuple[int, int]]:
        """(node, depth) in page order."""
        out, work = [], [(0, 0)]
        while work:
            node, depth = work.pop()
            out.append((node, depth))
            work += [(k, depth + 1) for k in reversed(self.kids[node])]
        return out

    def text(self) -> str:
        return " ".join(f"{depth}:{self.support[node]}:{self.labels[node]}" for node, depth in self.walk())

    @staticmethod
    def of(text: str) -> Tree:
        """From its text, numbered in page order."""
        tree, path = Tree(), []
        for part in text.split(" "):
            depth, support, label = part.split(":", 2)
            node = tree.add(label, int(support))
            del path[int(depth) :]
            if path:
                tree.kids[path[-1]].append(node)
            path.append(node)
        return tree


def _label(tag: str, attrs: str) -> str:
    names = sorted({w for m in _NAMES.finditer(attrs) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()) if w}) if attrs else ()
    return ".".join((tag, *names))


def parse(page: str) -> tuple[Tree, list[tuple[int, str, int]]]:
    """The page's tree, and its blocks in page order as (node number, text, characters inside links)."""
    tree = Tree()
    labels, kids = tree.labels, tree.kids
    tree.add("html")
    by_label: dict[int, dict[str, int]] = {}  # of nodes with very many kids
    stack: list[tuple[str, int]] = [("", 0)]  # tag, block node
    opened: dict[str, int] = {}
    blocks: list[tuple[int, str, int]] = []
    parts: list[str] = []
    links = in_link = 0

    def close_block() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                blocks.append((stack[-1][1], text, min(links, len(text))))
            parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if in_link:
                links += len(text.strip())

    def push(tag: str, node: int) -> None:
        stack.append((tag, node))
        opened[tag] = opened.get(tag, 0) + 1

    def pop() -> None:
        nonlocal in_link
        tag = stack[-1][0]
        if tag not in _INLINE:
            close_block()
        elif tag == "a":
            in_link = max(0, in_link - 1)
        opened[tag] -= 1
        stack.pop()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if end:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if tag in _LINE_BREAKS:
            add(" ")
            continue
        if tag in _VOID or attrs.endswith("/") and tag not in _INLINE:
            if tag == "hr":
                close_block()
            continue
        if len(stack) > _DEEPEST:
            while stack[-1][0] in _INLINE:
                pop()
            if len(stack) > 1:
                pop()
        if tag in _INLINE:
            push(tag, stack[-1][1])
            in_link += tag == "a"
            continue
        ends = _ENDS_OPEN.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            open_tag = stack[k][0]
            if open_tag == "p" or open_tag in ends:
                while len(stack) > k:
                    pop()
            elif open_tag in _BORDERS:
                break
        close_block()
        parent = stack[-1][1]
        if tag in ("html", "body"):
            push(tag, parent)
            continue
        label, near = _label(tag, attrs), kids[parent]
        if near and labels[near[-1]] == label:
            node = near[-1]
        elif len(near) < _WIDEST or label not in by_label.setdefault(parent, {labels[k]: k for k in near}):
            node = tree.add(label)
            near.append(node)
            if parent in by_label:
                by_label[parent][label] = node
        else:
            node = by_label[parent][label]
        push(tag, node)
    while len(stack) > 1:
        pop()
    close_block()
    order = {node: number for number, (node, _) in enumerate(tree.walk())}
    return tree, [(order[node], text, link) for node, text, link in blocks]


def matched(a: Tree, b: Tree, x: int = 0, y: int = 0, known: dict | None = None) -> int:
    """Simple tree matching: the most nodes that two subtrees with equal roots share in order."""
    known = {} if known is None else known
    if a.labels[x] != b.labels[y]:
        return 0
    work = [(x, y)]
    while work:
        pair = work[-1]
        if pair in known:
            work.pop()
            continue
        left, right = a.kids[pair[0]], b.kids[pair[1]]
        asked = [(i, j) for i in left for j in right if a.labels[i] == b.labels[j] and (i, j) not in known]
        if asked:
            work += asked
            continue
        known[pair] = _shared(a, b, left, right, known)[-1][-1] + 1
        work.pop()
    return known[x, y]


def _shared(a: Tree, b: Tree, left: list[int], right: list[int], known: dict) -> list[list[int]]:
    """Nodes shared by each pair of beginnings of two lists of kids, whose pairs of equal labels are known."""
    rows = [[0] * (len(right) + 1)]
    for i in left:
        before, row = rows[-1], [0]
        for j, y in enumerate(right):
            pair = known[i, y] if a.labels[i] == b.labels[y] else 0
            row.append(max(row[j], before[j + 1], before[j] + pair))
        rows.append(row)
    return rows


def align(template: Tree, page: Tree, grow: bool = True) -> dict[int, int]:
    """Partners {page node: template node}. Where the template may grow, page nodes without a partner are put into it
    beside their neighbours; else they have none."""
    known: dict = {}
    matched(template, page, 0, 0, known)
    pairs, work = {0: 0}, [(0, 0, False)]
    while work:
        x, y, fresh = work.pop()
        template.support[x] += grow and page.support[y]
        left, right = template.kids[x], page.kids[y]
        partner: dict[int, int] = {}
        if not fresh and left and right:
            best = _shared(template, page, left, right, known)
            i, j = len(left), len(right)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    partner[right[j]] = left[i]
        kids, place = list(left), 0
        at = {k: n for n, k in enumerate(left)}
        grown = 0
        for k in right:
            if k in partner:
                pairs[k] = partner[k]
                place = at[partner[k]] + grown + 1
                work.append((partner[k], k, False))
            elif grow:
                node = template.add(page.labels[k], 0)
                kids.insert(place, node)
                place, grown = place + 1, grown + 1
                pairs[k] = node
                work.append((node, k, True))
        template.kids[x] = kids
    return pairs


def merged(trees: list[str], most_rare: int = 64) -> str:
    """One template of some layouts or templates. A node that fewer than one in ``most_rare`` of the layouts have is
    left out with all below it: it tells nothing of the others, and the template does not grow with odd names."""
    template = Tree.of(trees[0])
    for text in trees[1:]:
        align(template, Tree.of(text))
    least = template.support[0] / most_rare
    for node, _ in template.walk():
        template.kids[node] = [k for k in template.kids[node] if template.support[k] >= least]
    return template.text()


def _words(label: str) -> list[str]:
    return label.split(".")


def is_furniture(label: str) -> bool:
    tag, *names = _words(label)
    return tag in _FURNITURE_TAGS or not _FURNITURE_NAMES.isdisjoint(names)


def is_content(label: str) -> bool:
    tag, *names = _words(label)
    return tag in _CONTENT_TAGS or tag in ("div", "section", "td") and not _CONTENT_NAMES.isdisjoint(names)


_LEAST = 32  # smallest hashes of a slot's blocks, from which their number of different ones is reckoned
_FEW_BLOCKS = 3  # with fewer, nothing tells a template from a slot


@dataclass
class Slot:
    """What pages put into a node: characters, those in links, blocks, and the smallest hashes of their texts."""

    chars: int = 0
    links: int = 0
    blocks: int = 0
    least: tuple[int, ...] = ()

    def variety(self) -> float:
        """The share of its blocks that differ."""
        n = len(self.least)
        return min(1.0, (n if n < _LEAST else (_LEAST - 1) * 2.0**63 / (self.least[-1] + 1)) / self.blocks)

    def running(self) -> int:
        """Characters outside links, none where most are inside."""
        return 0 if self.links > 0.5 * self.chars else self.chars - self.links


def _kind(label: str) -> str:
    """The label without names that say nothing of furniture or content, as of categories, slugs and post numbers."""
    tag, *names = _words(label)
    return ".".join((tag, *(n for n in names if n in _FURNITURE_NAMES or n in _CONTENT_NAMES)))


def content_nodes(tree: Tree, own: dict[int, Slot], shared: dict[int, Slot]) -> set[int]:
    """Nodes of one layout whose text is main text. ``own`` has what its own pages put into its nodes, ``shared`` what
    all pages of the host put into the template's nodes that these align with.

    A node whose blocks differ far less than those of the host's text is template; the others are slots. From the root
    down, the region is the node that has most of the text in slots, as long as it has no headings or paragraphs of its
    own. Where several nodes share that text, marked content breaks the tie. Within the region furniture is out by tag
    or name, and what is template or links, unless the region is marked as content."""
    evidence = {n: shared.get(n, slot) for n, slot in own.items()}
    running = {n: slot.running() for n, slot in own.items()}
    rich = sum(running.values()) / 10
    known = [n for n in own if evidence[n].blocks >= _FEW_BLOCKS]
    usual = max((evidence[n].variety() for n in known if running[n] >= rich), default=0.0)
    template = {n for n in known if evidence[n].variety() < 0.5 * usual}

    order = [n for n, _ in tree.walk()]
    parent = {k: n for n in order for k in tree.kids[n]}
    furniture: set[int] = set()
    for n in order:
        if n and (parent[n] in furniture or is_furniture(tree.labels[n])):
            furniture.add(n)
    weight = {n: 0 if n in template or n in furniture else running.get(n, 0) for n in order}
    for n in reversed(order[1:]):
        weight[parent[n]] += weight[n]

    tag = lambda n: tree.labels[n].split(".")[0]
    region = 0
    while heavy := max(tree.kids[region], key=weight.__getitem__, default=0):
        if any(tag(k) in _PARAGRAPHS and weight[k] for k in tree.kids[region]) or weight[heavy] < 0.75 * weight[region] or not weight[heavy]:
            break
        region = heavy
    above = [region]
    while above[-1]:
        above.append(parent[above[-1]])
    regions, marked = [region], any(is_content(tree.labels[n]) for n in above)
    if not marked:
        found, work = [], [region]
        while work:
            n = work.pop()
            if n in furniture or not weight[n]:
                continue
            if is_content(tree.labels[n]):
                found.append(n)
            else:
                work += tree.kids[n]
        if found:
            share: dict[str, int] = {}
            for n in found:
                share[_kind(tree.labels[n])] = share.get(_kind(tree.labels[n]), 0) + weight[n]
            regions, marked = [n for n in found if share[_kind(tree.labels[n])] >= 0.1 * max(share.values())], True
    inside, work = set(), list(regions)
    while work:
        n = work.pop()
        if n not in furniture:
            work += tree.kids[n]
            if n in own and (marked or n not in template and own[n].links <= 0.5 * own[n].chars):
                inside.add(n)
    return inside


_SLOT = "chars long, links long, blocks long, least array<long>"
_SUM_COLUMNS = f"host string, layout binary, tree string, node int, {_SLOT}"
_ROWS_AT_ONCE = 1 << 14


def _slots(values: list[dict]) -> dict[int, Slot]:
    return {v["node"]: Slot(v["chars"], v["links"], v["blocks"], tuple(v["least"])) for v in values}


def _layout(tree: Tree) -> tuple[str, bytes]:
    text = tree.text()
    return text, hashlib.blake2b(text.encode(), digest_size=16).digest()


def _sums(batches):
    """Each layout's tree (node -1) and what the pages of a task put into its nodes."""
    kinds = [pa.string(), pa.binary(), pa.string(), pa.int32(), *[pa.int64()] * 3, pa.list_(pa.int64())]
    names = ["host", "layout", "tree", "node", "chars", "links", "blocks", "least"]
    found: dict[tuple[str, bytes], tuple[str, dict[int, list]]] = {}
    held = 0

    def rows():
        for (host, layout), (tree, nodes) in found.items():
            yield host, layout, tree, -1, 0, 0, 0, []
            for node, (chars, links, blocks, least) in nodes.items():
                yield host, layout, None, node, chars, links, blocks, sorted(least)[:_LEAST]

    def flush():
        out = list(rows())
        for at in range(0, len(out), _ROWS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + _ROWS_AT_ONCE]), kinds)], names)

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tree, blocks = parse(page or "")
            text, layout = _layout(tree)
            nodes = found.setdefault((host, layout), (text, {}))[1]
            before = len(nodes)
            for node, block, links in blocks:
                slot = nodes.setdefault(node, [0, 0, 0, set()])
                slot[0] += len(block)
                slot[1] += links
                slot[2] += 1
                slot[3].add(xxhash.xxh64_intdigest(block) >> 1)
                if len(slot[3]) > 64 * _LEAST:
                    slot[3] = set(sorted(slot[3])[:_LEAST])
            held += len(nodes) - before
            if held > 4 * _ROWS_AT_ONCE:
                yield from flush()
                found, held = {}, 0
    yield from flush()


def _templates(layouts: DataFrame, at_once: int = 256) -> DataFrame:
    """(host, template): a host's layouts are merged ``at_once`` in a task, then the templates of the tasks."""
    most = layouts.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    groups = -(-most // at_once)
    now = layouts.select("host", F.pmod(F.xxhash64("layout"), F.lit(groups)).alias("part"), "tree")

    def run(table: pa.Table) -> pa.Table:
        tree = merged(sorted(table["tree"].to_pylist(), key=lambda t: (-int(t.split(":", 2)[1]), t)))
        return pa.table({"host": pa.array([table["host"][0].as_py()], pa.string()), "part": pa.array([table["part"][0].as_py()], pa.int64()), "tree": [tree]})

    while True:
        now = as_table(now.groupBy("host", "part").applyInArrow(run, "host string, part long, tree string"))
        if groups == 1:
            return now.select("host", F.col("tree").alias("template"))
        groups = -(-groups // 16)
        now = now.withColumn("part", F.pmod("part", F.lit(groups)))


def _placed(batches):
    """The template node of each node of a layout; -1 for none."""
    for batch in batches:
        places = []
        for tree, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            page = Tree.of(tree)
            pairs = align(Tree.of(template), page, grow=False)
            places.append([pairs.get(n, -1) for n in range(len(page.labels))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(places, pa.list_(pa.int32()))], ["host", "layout", "tree", "places"])


def _decided(batches):
    """Whether each node of a layout is main text."""
    for batch in batches:
        keep = []
        for tree, places, own, host in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            page, slots = Tree.of(tree), _slots(host or [])
            shared = {n: slots[p] for n, p in enumerate(places) if p in slots}
            inside = content_nodes(page, _slots(own or []), shared)
            keep.append([n in inside for n in range(len(page.labels))])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.list_(pa.bool_()))], ["host", "layout", "keep"])


def _wrappers(pages: DataFrame) -> DataFrame:
    """(host, layout, keep). Pages meet only as sums over each task, so a host of any size costs a row for each task,
    layout and node; its layouts are aligned with a template that is merged from them in rounds."""
    slot = [F.sum(c).alias(c) for c in ("chars", "links", "blocks")]
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("least")))), 1, _LEAST).alias("least")
    total = as_table(pages.select("host", "_html").mapInArrow(_sums, _SUM_COLUMNS).groupBy("host", "layout", "node").agg(F.min("tree").alias("tree"), *slot, least))
    layouts = total.where("node = -1").select("host", "layout", "tree")
    found = total.where("node >= 0").drop("tree")
    placed = as_table(layouts.join(_templates(layouts), "host").select("host", "layout", "tree", "template").mapInArrow(_placed, "host string, layout binary, tree string, places array<int>"))
    every = F.collect_list(F.struct("node", "chars", "links", "blocks", "least"))
    host = found.join(placed.drop("tree"), ["host", "layout"]).withColumn("node", F.get("places", F.col("node"))).where("node >= 0")
    host = host.groupBy("host", "node").agg(*slot, least).groupBy("host").agg(every.alias("shared"))
    own = found.groupBy("host", "layout").agg(every.alias("own"))
    asked = placed.join(own, ["host", "layout"], "left").join(host, "host", "left").select("host", "layout", "tree", "places", "own", "shared")
    return asked.mapInArrow(_decided, "host string, layout binary, keep array<boolean>")


def _parsed(pages: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            layouts, rows = [], []
            for page in batch.column(3).to_pylist():
                tree, blocks = parse(page or "")
                layouts.append(_layout(tree)[1])
                rows.append([dict(node=n, text=t) for n, t, _ in blocks])
            kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(layouts, pa.binary()), pa.array(rows, kind)], ["_id", "url", "host", "layout", "blocks"])

    schema = "_id long, url string, host string, layout binary, blocks array<struct<node:int,text:string>>"
    return pages.select("_id", "url", "host", "_html").mapInArrow(run, schema)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = 32 << 20) -> DataFrame:
    """``(id, url, text, n_chars)`` for every page: its main blocks in page order, joined by line ends.

    Pages are read and parsed twice, for the wrappers and for the text, so that no copy of them is written. Wrappers
    (a row for each layout of a host) go to all tasks while they have at most ``most_broadcast`` bytes, and are joined
    by a shuffle beyond. Three bounds keep a layout's size from growing with a page: elements more than 512 deep count as
    their ancestor's children, of a node's children beyond 256 those of one label are one node, and a node that fewer than
    one in 64 of a host's layouts have is left out of the host's template. A null, empty or furniture-only page has an empty text; pages without a host share one
    wrapper; an empty table gives no rows; other columns are not read.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    source = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("_html"))
    source = source.withColumn("host", host)
    found = as_table(_wrappers(source))
    size = found.agg(F.sum(F.length("host") + 48 + F.size("keep"))).first()[0] or 0
    chosen = F.expr("array_join(transform(filter(blocks, b -> keep[b.node]), b -> b.text), '\n')")
    out = _parsed(source).join(F.broadcast(found) if size <= most_broadcast else found, ["host", "layout"], "left")
    out = out.select("_id", "url", F.coalesce(chosen, F.lit("")).alias("text"))
    return out.select(F.col("_id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
