import datetime as dt

import pytest
from pyspark.sql import functions as F

from vesperline.operators import exceptions, extract, quality, spans
from vesperline.sources import notes

NOTE = """# Notes

### TODO Water the ferns
`SCHEDULED: <2023-11-09 Thu>`
`CLOCK: [2025-03-04 Tue 06:15]--[2025-03-04 Tue 08:00] => 1:45`

First *para*
goes on `gone` here.

Second para.

## Monthly
    `DEADLINE: <2023-11-09 Thu +1m -3d>`

## Created only
`CREATED: [2026-01-12 Пн]`

## Plain heading

text

## [#15] Two evenings
`<2025-03-04 Tue 19:30>-<2025-03-05 Wed 21:15>`

## [#65] Above
`CLOSED: [2027-04-15 Thu]`

Setext TODO
-----------
`<2027-04-15 Чт>`

## Позже, с меткой [#A] в середине
`SCHEDULED: [2027-04-15 Thu]`
`<2027-14-40>`

## CANCELED Props
```org-properties
ID: a
ID: b
EMPTY:
no colon
EXDATE: 2025-9-18, 2025-09-18 10:30 12:45 thursday
RECURRENCE_ID: 2025-09-18 10:30:00
SERIES_ID:  s1
```
```
# TODO not a heading
```
~~~
`SCHEDULED: <2030-01-01>`
~~~
"""


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([("r", "n.md", NOTE)], "root string, file string, text string")
    found = extract.tasks(df).persist()
    return {r.heading: r for r in found.collect()}, found


def test_golden_sections(rows):
    by = rows[0]
    assert set(by) == {"Water the ferns", "Monthly", "Created only", "Two evenings", "[#65] Above", "Setext TODO", "Позже, с меткой [#A] в середине", "Props"}
    pin = by["Water the ferns"]
    assert (pin.line, pin.task_type, pin.timestamp, pin.timestamp_type, pin.timestamp_active) == (3, "TODO", "SCHEDULED: <2023-11-09 Thu>", "SCHEDULED", True)
    assert pin.content == "First paragoes on  here.\n\nSecond para." and pin.total_clock_time == "1:45" and pin.clock_minutes == 105
    assert by["Monthly"].timestamp == "DEADLINE: <2023-11-09 Thu +1m -3d>" and by["Monthly"].timestamp_repeater == "+1m" and by["Monthly"].warning_days == 3
    assert by["Created only"].created == "CREATED: [2026-01-12 Mon]" and by["Created only"].task_type is None
    mid = by["Two evenings"]
    assert (mid.priority, mid.priority_order, mid.timestamp) == ("15", 15, "<2025-03-04 Tue 19:30>--<2025-03-05 Wed 21:15>")
    assert (mid.timestamp_date, mid.timestamp_time, mid.timestamp_end_time) == ("2025-03-04", "19:30", "21:15")
    assert by["[#65] Above"].priority is None and by["[#65] Above"].timestamp_active is False
    assert by["Setext TODO"].timestamp == "<2027-04-15 Thu>" and by["Setext TODO"].task_type is None
    odd = by["Позже, с меткой [#A] в середине"]
    assert (odd.priority, odd.timestamp, odd.base_date) == ("A", "<2027-14-40>", None)
    props = by["Props"]
    assert props.task_type == "CANCELED" and props.properties["ID"] == "b" and props.properties["EMPTY"] == ""
    assert props.excluded_dates == [dt.date(2025, 9, 18)] and props.recurrence_id == "2025-09-18 10:30" and props.series_id == "s1"
    assert props.timestamp == "SCHEDULED: <2030-01-01>"  # the fence's own code span is unwrapped


def test_findings(rows):
    found = {(r.channel, r.key, r.value) for r in quality.findings(rows[1]).collect()}
    assert ("timestamp", "PLAIN", "<2027-14-40>") in found and ("property", None, "no colon") in found
    assert ("property", "EXDATE", "12:45") in found and ("property", "EXDATE", "thursday") in found and ("property", "EXDATE", "10:30") not in found


@pytest.mark.parametrize("raw,dates,bad", [
    ("2025-03-04, 2025-03-11 2025-03-18", 3, []), ("2025-03-04, some monday", 1, ["some", "monday"]), ("9:10, 2025-03-04 9:10 11:20", 1, ["9:10", "11:20"]),
    ("2025-3-4,\t2025-03-04", 1, []), (" , ", 0, []), ("2025-02-29", 0, ["2025-02-29"]),
])
def test_excluded_dates(spark, raw, dates, bad):
    from pyspark.sql import functions as F

    row = spark.range(1).select(exceptions.excluded_dates(F.lit(raw)).alias("d"), exceptions.rejected_fields(F.lit(raw)).alias("b")).first()
    assert len(row.d) == dates and row.b == bad


def test_recurrence_ids_durations_and_repeaters(spark):
    from pyspark.sql import functions as F

    from vesperline.functions import stamps

    ids = ["2025-03-04 17:45:00", "2025-03-04 at night", "monday 17:45", "2025-03-04"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i").select(exceptions.recurrence(F.col("x")).alias("r")).collect()
    assert [r.r and (r.r.value, r.r.dropped) for r in rows] == [("2025-03-04 17:45", None), ("2025-03-04", "at night"), None, ("2025-03-04", None)]
    spent = ["2:05", "1:60", "99999:00", "1:2:3", "", "0:00"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(spent)], "i int, x string").orderBy("i").select(extract.minutes(F.col("x")).alias("m")).collect()
    assert [r.m for r in rows] == [125, None, None, None, None, 0]
    reps = {"+0d": None, "1d": None, "+": None, "+1q": None, "+abd": None, "..+1d": None, "+++1d": "++1d", "+1week": "+1w", ".+2m": ".+2m", "+5wd": "+5wd"}
    rows = spark.createDataFrame([(f"<2027-04-15 Thu {k}>", v) for k, v in reps.items()], "s string, want string")
    assert all(r.want == r.got for r in rows.select("want", stamps.repeater_text(stamps.repeater(F.col("s"))).alias("got")).collect())
    lead = {"-3d": 3, "-2w": 14, "-1m": 30, "-1y": 365, "-5h": 0}
    rows = spark.createDataFrame([(f"DEADLINE: <2025-12-10 Wed {k}>", v) for k, v in lead.items()], "s string, want long")
    assert all(r.want == r.got for r in rows.select("want", stamps.warning_days(F.col("s")).alias("got")).collect())


def test_heading_spans_slice_the_line(spark):
    lines = ["## TODO [#A] Fold the map", "# TODO spare [#B] Title", "# CANCELED Dropped trip", "### DONE Größe [#C] é"]
    df = spark.createDataFrame([("r", "f", "\n".join(lines))], "root string, file string, text string")
    for r in spans.heading_spans(df).collect():
        raw = lines[r.line - 1].encode()
        for part in (r.state, r.mark, r.title):
            if part:
                assert raw[part.start : part.end].decode() == part.text
        assert r.title.text in ("Fold the map", "spare [#B] Title", "Dropped trip", "Größe [#C] é")


def test_files_gates_and_arrivals(spark, tmp_path):
    root = tmp_path / "a"
    (root / "sub").mkdir(parents=True)
    (root / "x.md").write_bytes(b"\xef\xbb\xbf# TODO first\n")
    (root / "sub" / "y.md").write_bytes(b"# TODO \xff\n")
    (root / "z.md").write_bytes(b"# CANCELLED only\n")
    raw = notes.read_raw(spark, [str(root), str(root) + "/"])
    assert {r.file: r.gate for r in notes.gated(raw).collect()} == {"x.md": "parsed", "sub/y.md": "not_utf8", "z.md": "no_marker"}
    assert [(r.root, r.heading) for r in extract.tasks(notes.notes(raw)).collect()] == [(None, "first")]
    report = notes.scan_report(raw).first()
    assert (report.files, report.parsed, report.not_utf8, report.no_marker, report.first_failed) == (3, 1, 1, 1, "sub/y.md")
    with pytest.raises(ValueError):
        notes.glob_to_regex("*.")
    from vesperline.streaming.arrivals import extract_arrivals

    spark.createDataFrame([("r", "n.md", "# TODO streamed\n")], "root string, file string, text string").write.parquet(str(tmp_path / "in"))
    query = extract_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert [r.heading for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["streamed"]


def test_fences_close_by_style_and_length_and_underlines_make_headings():
    from vesperline.operators.blocks import sections_of

    text = (
        "lead\n# A\npara\nmore\n    runs on\n- item\nlazy\n    held\n\n~~~ org-properties\n```\n# no\n~~~~\n````x\n```\nstill\n`````\nTwo\nlines\n---\nlast\n***\n    code\n# B #\n"
        "``` a`b\n===\n~~~\n# open to the end"
    )
    found = sections_of(text)
    assert [(s.line, s.level, s.title) for s in found] == [(2, 1, "A"), (18, 2, "Two\nlines"), (24, 1, "B"), (25, 1, "``` a`b")]
    assert [(b[0], b[1], b[2], b[3]) for b in found[0].blocks] == [(3, "text", ["para", "more", "    runs on"], None), (10, "fence", ["```", "# no"], "org-properties"), (14, "fence", ["```", "still"], "x")]
    assert [b[1] for b in found[1].blocks] == ["text", "indented"] and found[3].blocks == [[27, "fence", ["# open to the end"], ""]]
    assert sections_of("") == [] and sections_of("no heading\r\n\r# yes\r\n")[0].line == 3


def test_globs():
    import re

    from vesperline.sources.notes import glob_to_regex

    met = lambda pattern, path: bool(re.match(glob_to_regex(pattern), path))
    assert met("*.{md,markdown}", "a.markdown") and not met("*.{md,markdown}", "a.txt") and met("n[0-9]/[!a-c]*.md", "n4/d.md") and not met("n[0-9]/[!a-c]*.md", "n4/b.md")
    assert met("**/x[]-].md", "a/b/x].md") and met("{a,b{c,d}}.md", "bd.md") and not met("[!a]b", "/b")
    for bad in ("", "*.", "[a", "{a,b", "a}", "[]"):
        with pytest.raises(ValueError):
            glob_to_regex(bad)


def test_days_in_zones_and_escapes(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from vesperline.functions import text, windows

    day, now = windows.now_in("Pacific/Kiritimati")
    assert isinstance(day, dt.date) and re_time(now) and windows.now_in("UTC", "2025-02-01") == (dt.date(2025, 2, 1), "00:00")
    with pytest.raises(ValueError):
        windows.now_in("Mars/Base")
    row = spark.range(1).select(text.markdown_escaped(F.lit("a*b_\u202e[x]|<y>\\\\`#")).alias("e"), windows.day_in(F.lit("2025-03-01 23:30:00").cast("timestamp"), "Asia/Tokyo").alias("d")).first()
    assert row.e == "a\\*b\\_\\[x\\]\\|\\<y\\>\\\\\\\\\\`\\#" and row.d == dt.date(2025, 3, 2)


def re_time(text):
    return len(text) == 5 and text[2] == ":"


def test_run_report(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# TODO one\n")
    (tmp_path / "b.md").write_bytes(b"# TODO \xff\n")
    raw = notes.read_raw(spark, [str(tmp_path)])
    found = extract.tasks(notes.notes(raw))
    r = notes.run_report(raw, found.count(), quality.findings(found), cap=1).first()
    assert (r.files, r.parsed, r.not_utf8, r.failed_paths, r.warnings, r.cap_reached) == (2, 1, 1, ["b.md"], 0, True)


def test_a_cap_reads_its_tasks_once(spark, tmp_path):
    def noted(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open(tmp_path / f"{row['root']}{row['file']}{row['line']}", "a") as out:
                    out.write("x")
            yield batch

    rows = [(root, f"{k % 7}.md", line) for k in range(7) for root in ("b", "a", None) for line in (3, 1, 2)]
    found = spark.createDataFrame(rows, "root string, file string, line int").repartition(5)
    kept = extract.capped(found.mapInArrow(noted, found.schema), 20).collect()
    in_order = sorted(rows, key=lambda r: (r[0] is not None, *map(str, r)))
    assert sorted(map(tuple, kept), key=str) == sorted(in_order[:20], key=str)
    assert sorted(p.read_text() for p in tmp_path.iterdir()) == ["x"] * len(rows)
    for cap in (1, 13, 62, 63, 100):
        assert {tuple(r) for r in extract.capped(found, cap).collect()} == set(in_order[:cap])


def test_a_run_counts_on_its_one_pass(spark, tmp_path):
    """Every kind of file, and roots that are one folder by other names."""
    import os

    from vesperline.sources import note_files

    base = tmp_path / "notes"
    (base / "sub" / ".git").mkdir(parents=True)
    files = {"a.md": b"# TODO a\n# DONE b\n", "_b.md": b"# TODO c\n```org-properties\nnone\n```\n", ".c.md": b"# TODO d\n", "sub/.git/e.md": b"# TODO e\n", "sub/f.md": b"# TODO \xff\n", "g.md": b"\xff plain\n",
             "sub/h.md": b"\xef\xbb\xbf# TODO h\n`DEADLINE: <2020-13-01>`\n", "i.txt": b"# TODO i\n", "j.md": b"# TODO j\n" + b"x" * (11 << 20)}
    for name, content in files.items():
        (base / name).write_bytes(content)
    os.symlink(base / "a.md", base / "link.md")
    os.symlink(base, tmp_path / "other")
    (base / os.fsdecode(b"k\xff.md")).write_bytes(b"# TODO k\n")
    raw = note_files.read_files(spark, [str(base), f"{base}/sub/..", f"file://{tmp_path}/other/"], "*.md")
    run = notes.Run(raw)
    r = run.report.first()
    assert (r.files, r.parsed, r.failed, r.oversize, r.not_utf8, r.no_marker, r.odd_paths) == (7, 4, 0, 1, 1, 1, 1)
    assert (r.tasks, r.timestamp_findings, r.property_findings, r.cap_reached, r.has_warnings, r.failed_paths) == (5, 1, 1, False, True, ["j.md", "sub/f.md"])
    assert sorted((t.file, t.heading) for t in run.tasks.collect()) == [("_b.md", "c"), ("a.md", "a"), ("a.md", "b"), ("k\ufffd.md", "k"), ("sub/h.md", "h")]
    assert notes.Run(raw, cap=2).report.first().cap_reached and [t.heading for t in notes.Run(raw, cap=2).tasks.collect()] == ["c", "a"]
    two = note_files.read_files(spark, [str(base / "sub"), str(base)], "**/*.md", absolute_paths=True).where("root is not null")
    assert two.select("root").distinct().count() == 2 and two.where("file like '%/f.md'").count() == 2
    with pytest.raises(ValueError):
        note_files.read_files(spark, [str(tmp_path / "none")])


def test_files_that_cannot_be_read_are_rows(tmp_path):
    from vesperline.sources.note_files import _Reader

    (tmp_path / "a.md").write_bytes(b"12345")
    (tmp_path / "b.md").write_bytes(b"x")
    reader = _Reader({"roots": str(tmp_path), "cap": "10"})
    parts = reader.partitions()
    (tmp_path / "b.md").unlink()
    (tmp_path / "a.md").write_bytes(b"123456789012345")  # it has grown since it was listed
    rows = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert [(r["file"], r["length"], r["content"], r["error"] is None) for r in rows] == [("a.md", 11, None, True), ("b.md", 1, None, False)]


def test_globs_reach_the_listing(spark, tmp_path):
    for name in ("a.md", "b.txt", "sub/c.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"# TODO x\n")
    raw = notes.read_raw(spark, [str(tmp_path)], glob="*.md")
    assert sorted(r.file for r in raw.select("file").collect()) == ["a.md", "sub/c.md"] and len(raw.inputFiles()) == 2
    assert [r.file for r in notes.read_raw(spark, [str(tmp_path)], glob="sub/*").select("file").collect()] == ["sub/c.md"]


def test_limit_of_each_note(spark):
    text = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda k: F.concat(F.lit("# TODO t"), k.cast("string"))))
    raw = spark.range(1, 4).select(F.lit(None).cast("string").alias("root"), F.concat(F.col("id").cast("string"), F.lit(".md")).alias("file"), text.alias("text"))
    raw = raw.select("root", "file", F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    whole = notes.Run(raw, note_cap=4).report.first()  # more tasks than the limit in all, fewer in each note
    assert (whole.tasks, whole.task_limit, whole.cap_reached) == (6, 4, False)
    cut = notes.Run(raw, note_cap=2)
    assert (cut.report.first().tasks, cut.report.first().cap_reached) == (5, True)
    assert sorted((t.file, t.heading) for t in cut.tasks.collect()) == [("1.md", "t1"), ("2.md", "t1"), ("2.md", "t2"), ("3.md", "t1"), ("3.md", "t2")]
    with pytest.raises(ValueError):
        notes.Run(raw, 2, 2)


def test_findings_in_one_pass(spark):
    """Findings need no written table: the tasks are read once, whatever the kinds of findings."""
    text = "# TODO a\n`DEADLINE: <2020-13-01>`\n```org-properties\nno pair\nEXDATE: later\nRECURRENCE_ID: noon\n```\n"
    found = quality.findings(extract.tasks(spark.createDataFrame([("r", "n.md", text)], "root string, file string, text string")))
    assert {(r.line, r.channel, r.key, r.value, r.problem) for r in found.collect()} == {
        (1, "timestamp", "DEADLINE", "DEADLINE: <2020-13-01>", "not a calendar date"), (4, "property", None, "no pair", "not a key and a value"), (1, "property", "EXDATE", "later", "not a date"),
        (1, "property", "RECURRENCE_ID", "noon", "not a date"), (1, "property", "SERIES_ID", "", "half a pair"),
    }
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_heading_lines_are_those_of_sections(spark):
    from vesperline.operators import blocks

    df = spark.createDataFrame([("r", "n.md", NOTE), ("r", "empty.md", None)], "root string, file string, text string")
    whole = blocks.sections(df).where("written is not null").select("file", "line", "written").collect()
    assert sorted(blocks.heading_lines(df).select("file", "line", "written").collect()) == sorted(whole) != []


def test_fields_of_a_stamp_are_computed_in_steps(spark):
    """No field searches the stamp for what another one has found: a pattern stands once in the plan for each use."""
    df = spark.createDataFrame([("r", "n.md", NOTE)], "root string, file string, text string")
    plan = extract.tasks(df, parts=("stamps",)).select("rep", "timestamp_repeater")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("([.+]+[0-9]+(?:wd|[dwmyh]))") == 1


def test_clock_entries_by_part(spark):
    text = "CLOCK: [a]--<b> => 1:05 x CLOCK:<c> CLOCK: [d> CLOCK: [e]--[f => 2:00 CLOCK: [[g] => 100000:00"
    found = spark.range(1).select(extract.clock_entries(F.lit(text)).alias("c")).first().c
    assert [tuple(c) for c in found] == [("a", "b", "1:05"), ("c", None, None), ("e", None, None), ("[g", None, None)]


def test_files_over_the_cap_are_not_read(tmp_path):
    from vesperline.sources import note_files

    for k in range(20):
        with open(tmp_path / f"{k}.md", "wb") as f:
            f.truncate((11 << 20) if k else 5)
    reader = note_files._Reader({"roots": str(tmp_path), "cap": str(10 << 20)})
    [part] = reader.partitions()  # what is not read takes no part of a task
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert sorted((r["length"], r["content"], r["error"]) for r in rows if r["length"] > 5) == [(11 << 20, None, None)] * 19
    assert [r["content"] for r in rows if r["length"] == 5] == [bytes(5)]
    (tmp_path / "1.md").write_bytes(b"shrunk")
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [(r["length"], r["content"]) for r in rows if r["file"] == "1.md"] == [(6, b"shrunk")]
