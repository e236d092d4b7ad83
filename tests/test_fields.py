"""Stamps and properties found in the pass over a note equal those that column expressions find in its blocks."""

from __future__ import annotations

import random

import pytest

from vesperline.operators import extract

_PIECES = [
    "`DEADLINE: <2024-01-02 Tue 10:00-11:00 +1w -3d>`", "`<2024-01-02>--<2024-01-05>`", "`<2024-01-02>-<2024-01-05>` `[2024-01-01]`", "`CLOSED: [2024-02-30 Вт]--[2024-03-01]`",
    "`CREATED: [2023-12-31 Воскресенье]`", "` SCHEDULED: <2024-05-06 Пн ++1m>--<2024-06-06>`", "`CLOCK: [2024-01-01 09:00]--[2024-01-01 10:00] => 1:00` `[2024-07-07]`",
    "`x CREATED: [2024-01-01]`", "`\x1c<2024-01-01>`", "*a* `<2024-08-09>` [b](c)", "    ``[2024-03-04] ` x``", "    `<2024-03-04>`", "```\n[2024-09-09]--[2024-09-10]\n```", "plain", "",
    "```org-properties\nID: a\n id : b\nID:　c \x1c\nno pair\n: none\nEXDATE: 2024-01-09, 2024-01-16: later\n```", "```org-properties\nZ: 1\nÉ: 2\nID:\n```", "~~~org-properties\n~~~",
]


@pytest.mark.parametrize("parts", [("stamps",), ("pairs",), ("properties",), ("clocks", "pairs"), ("clocks", "properties")])
def test_equal_to_fields_of_blocks(spark, parts):
    rng = random.Random(5)
    notes = []
    for k in range(60):
        sections = ["# TODO [#A] *t* " + str(j) + "\n" + "\n".join(rng.choice(("", "\n")) + rng.choice(_PIECES) for _ in range(rng.randrange(8))) for j in range(8)]
        notes.append(("r", f"{k}.md", "\r\n".join("\n".join(sections).split("\n")) if k % 7 == 0 else "\n".join(sections)))
    df = spark.createDataFrame([*notes, ("r", "none.md", None)], "root string, file string, text string")
    found = extract.tasks(df, parts=parts)
    names = sorted(found.columns)
    whole = extract.tasks(df).select(names)
    assert sorted(map(str, found.select(names).collect())) == sorted(map(str, whole.collect()))
    assert found.where("timestamp is not null").count() > 100 and found.where("created is not null").count() > 20


def test_blocks_do_not_leave_without_content(spark):
    df = spark.createDataFrame([("r", "n.md", "# TODO a\n`<2024-01-02>`\n")], "root string, file string, text string")
    assert "codes" not in extract.tasks(df, parts=("pairs",))._jdf.queryExecution().analyzed().toString()
