"""Notes from the orders whose lists, quotes, HTML and inline marks hide decoys; and SQL for what must be found.

Each order takes one of a few forms by its number. A form is written once, as lines of a note, with what it leaves of them
beside it, so SQL over the orders needs no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesperline.plans import order_notes as on

#: Lines that follow an order's heading, and what they add to the body. {k} is the order's number.
CONTAINERS = [
    (["- point", "  ```org-properties", "  ID: wrong-{k}", "  ```", "  # TODO inner {k}", "", "  `CLOSED: [1990-01-01 Mon]`", ""], ""),
    (["> # TODO quoted {k}", "> text", "lazy `SCHEDULED: <1990-01-01 Mon>`", "> ```", "> # TODO fenced {k}", "", "plain {k}", ""], "plain {k}"),
    (["<div class='x'>", "# TODO raw {k}", "`DEADLINE: <1990-01-01 Mon>`", "</div>", ""], ""),
    (["<!-- note", "", "# TODO hidden {k}", "", "-->", "seen {k}", ""], "seen {k}"),
    (["1. first", "   - deeper", "", "     # TODO deep {k}", "", "        code", "", " outside {k}", "2. no item", ""], "outside {k}2. no item"),
    (["* a", "* b", "***", "-", "", "  # TODO mine {k}", ""], None),
    (["[r{k}]: /u 'title'", "[r{k}] and", "<b>bold {k}</b>", "", "<x-tag y='1'>", "# TODO in tag {k}", "", ""], "r{k} andbold {k}"),
    (["    `CREATED: [1990-01-01 Пн]`", "", "~~~~ text", "`CREATED: [1990-01-02 Tue]`", "~~~", "~~~~", ""], ""),
    (["+ one", "", "\ttwo", "", "  ~~~", "  # TODO tilde {k}", "end {k}", ""], "end {k}"),
]

#: Marked texts, what they show as a heading, and what as a body. {k} is the order's number, {s} its status.
MARKS = [
    ("*one **two {k}* three**", "one two {k} three", None),
    ("**bold *in {k}* bold** _x_y_z_", "bold in {k} bold x_y_z", None),
    ("[link *{k}* `{s}`](</a b> \"t\") ![no](x)", "link {k} {s}", "link {k}"),
    ("![pic [in {k}](y)](z) a <b>b</b> <!-- c --> d", "a b  d", None),
    ("<https://x.example/{k}> &lt;{s}&gt; &copy; &#65;&#x42; &nope;", "https://x.example/{k} <{s}> © AB &nope;", None),
    (r"\*not {k}\* \[x](y) `a\`b", r"*not {k}* [x](y) a\b", r"*not {k}* [x](y) b"),
    ("[full][Ref {k}] [ref  {k}] [ref {k}][] [other {k}]", "full ref  {k} ref {k} [other {k}]", None),
    ("``a ` {k}`` *`{s}`* ~~old~~ ***both***", "a ` {k} {s} old both", "old both"),
    ("a*b {k}* * c * __d__e__ foo_bar_", "ab {k} * c * d__e foo_bar_", None),
    ("[a [b {k}](c)](d) [unclosed", "[a b {k}](d) [unclosed", None),
]

#: Fragments and what is shown of them.
FRAGMENTS = [
    ("> # Title *{k}*\n> - item `{s}`\n>   goes on\n\n    code\n\nlast", "Title {k}item {s}goes onlast"),
    ("## TODO **Report** {k} ##", "TODO Report {k}"),
    ("[a {k}]\n\n1. [A {k}]: /x\n2. <b>b</b>\n   ===\n~~~\nfence\n~~~\n", "a {k}b"),
    ("<div>{k}</div>\n\ntext {k}\n---\n* * *\n", "text {k}"),
    ("plain {k}  \nlines", "plain {k}lines"),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _of(text: str, spark: bool) -> str:
    """SQL for a form's text with the order's number and status put in."""
    literal = _quoted(text.replace("\\", "\\\\") if spark else text)
    if spark:
        return f"replace(replace({literal}, '{{k}}', cast(k as string)), '{{s}}', o_orderstatus)"
    return f"replace(replace({literal}, '{{k}}', cast(k as varchar)), '{{s}}', o_orderstatus)"


def _by(forms: list[str], n: int) -> str:
    return f"case k % {n} " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end"


def container_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(root, file, text)``: a note for each customer who has orders."""
    a = on.attributes(spark, sf_dir)
    n = len(CONTAINERS)
    body = [_of("\n".join(lines), True).replace("\n", "\\n").replace("\t", "\\t") for lines, _ in CONTAINERS]
    parts = a.select("file", "k", F.expr(rf"concat('## TODO Order ', k, '\n`', written, '`\n\n', {_by(body, n)}, '\n```org-properties\nID: order-', k, '\n```')").alias("section"))
    grouped = parts.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "section")))["section"], "\n").alias("text"))
    return grouped.select(F.lit(None).cast("string").alias("root"), "file", "text")


def containers_sql(attributes: str) -> str:
    """One row a task: an order's own, and that of a heading which only seems to be in its list."""
    n = len(CONTAINERS)
    size = _by([str(len(lines) + 6) for lines, _ in CONTAINERS], n)
    own = next(i for i, (_, body) in enumerate(CONTAINERS) if body is None)
    at = 4 + next(i for i, line in enumerate(CONTAINERS[own][0]) if "mine" in line)
    body = _by(["''" if b is None else _of(b, False) for _, b in CONTAINERS], n)
    wrapped = next(i for i, (lines, _) in enumerate(CONTAINERS) if "CREATED" in lines[0])
    created = f"case when k % {n} = {wrapped} then 'CREATED: [1990-01-01 Mon]' end"
    return f"""with a as ({attributes}), p as (select *, 1 + coalesce(sum({size}) over (partition by file order by k rows between unbounded preceding and 1 preceding), 0) as top from a)
      select file, top as line, concat('Order ', cast(k as varchar)) as heading, stamp as timestamp, case when k % {n} <> {own} then concat('order-', cast(k as varchar)) end as id, {created} as created, {body} as content from p
      union all select file, top + {at - 1}, concat('mine ', cast(k as varchar)), null, concat('order-', cast(k as varchar)), null, '' from p where k % {n} = {own}"""


def mark_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(root, file, text)``: a note for each order; the reference's definition stands at its end."""
    a = on.attributes(spark, sf_dir)
    marked = _by([_of(text, True) for text, *_ in MARKS], len(MARKS))
    text = rf"concat('# TODO ', {marked}, '\n', {marked}, '\n\n> [REF ', k, ']: /target')"
    return a.select(F.lit(None).cast("string").alias("root"), F.col("k").cast("string").alias("file"), F.expr(text).alias("text"))


def marks_sql(attributes: str) -> str:
    n = len(MARKS)
    heading = _by([_of(h, False) for _, h, _ in MARKS], n)
    content = _by([_of(h if b is None else b, False) for _, h, b in MARKS], n)
    return f"with a as ({attributes}) select cast(k as varchar) as file, {heading} as heading, {content} as content from a"


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(k, fragment)``, one for each order."""
    forms = [_of(text, True).replace("\n", "\\n") for text, _ in FRAGMENTS]
    return on.attributes(spark, sf_dir).select("k", F.expr(_by(forms, len(FRAGMENTS))).alias("fragment"))


def fragments_sql(attributes: str) -> str:
    return f"with a as ({attributes}) select k, {_by([_of(x, False) for _, x in FRAGMENTS], len(FRAGMENTS))} as displayed from a"
