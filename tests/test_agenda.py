import datetime as dt

import pytest

from vesperline.operators import agenda as ag
from vesperline.operators import exceptions, extract
from vesperline.sources import holidays, sinks
from vesperline.sources.scratch import as_table

D = dt.date.fromisoformat


def planned(spark, note):
    tasks = extract.tasks(spark.createDataFrame([("r", "n.md", note)], "root string, file string, text string"))
    return exceptions.with_replaced(tasks.persist()).persist()


def entries(spark, note, first, last=None, current=None):
    cal = holidays.calendar(spark, "2025-01-01", "2026-12-31").persist()
    found = ag.agenda(planned(spark, note), cal, D(first), D(last or first), D(current or first))
    return {(str(r.day), r.bucket, r.heading): r for r in found.collect()}


def note(*sections):
    return "\n".join(f"# {head}\n`{stamp}`\n" for head, stamp in sections)


def test_one_off_entries(spark):
    text = note(
        ("TODO due14", "DEADLINE: <2025-12-19 Fri>"), ("TODO due15", "DEADLINE: <2025-12-20 Sat>"), ("TODO lead", "DEADLINE: <2025-12-10 Wed -3d>"), ("TODO late", "SCHEDULED: <2025-11-29 Sat 9:00>"),
        ("past", "<2025-11-29 Sat>"), ("DONE done", "DEADLINE: <2025-11-29 Sat>"), ("DONE soon", "DEADLINE: <2025-12-06 Sat>"), ("off", "[2025-12-05 Fri]"), ("on", "<2025-12-05 Fri>"),
        ("TODO b [#B]", "SCHEDULED: <2025-12-05 Fri>"), ("TODO [#A] a", "SCHEDULED: <2025-12-05 Fri>"), ("TODO timed", "SCHEDULED: <2025-12-05 Fri 10:00>"),
    )
    found = entries(spark, text, "2025-12-05")
    day = "2025-12-05"
    assert (day, "upcoming", "due14") in found and (day, "upcoming", "due15") not in found and (day, "upcoming", "lead") not in found
    assert (day, "upcoming", "soon") in found and (day, "overdue", "done") not in found and not any(k[2] in ("past", "off") for k in found)
    late = found[day, "overdue", "late"]
    assert late.days_offset == -6 and late.time is None
    assert [found[day, "scheduled_no_time", h].rank for h in ("a", "b [#B]", "on")] == [1, 2, 3] and (day, "scheduled_timed", "timed") in found


def test_series_entries(spark):
    text = note(
        ("TODO monthly", "SCHEDULED: <2026-01-31 Sat ++1m>"), ("weekly", "<2026-05-14 Thu +1w>"), ("TODO work", "SCHEDULED: <2026-05-15 Fri +1wd>"), ("TODO ahead", "DEADLINE: <2026-05-26 Tue +1y>"),
    )
    found = entries(spark, text, "2026-05-18", "2026-05-24", "2026-05-21")
    monthly = found["2026-05-21", "overdue", "monthly"]
    assert (str(monthly.date), monthly.stamp, monthly.days_offset) == ("2026-04-30", "SCHEDULED: <2026-04-30 Thu ++1m>", -21)
    assert ("2026-05-21", "scheduled_no_time", "weekly") in found and not any(k[1] == "overdue" and k[2] == "weekly" for k in found)
    assert found["2026-05-21", "upcoming", "ahead"].days_offset == 5
    assert {k[0] for k in found if k[2] == "work"} == {"2026-05-18", "2026-05-19", "2026-05-20", "2026-05-21", "2026-05-22"}
    weekend = entries(spark, text, "2026-05-17")
    assert not any(k[2] == "work" for k in weekend)


@pytest.mark.parametrize("exception,owed", [("EXDATE: 2026-08-20", -11), ("", -4)])
def test_cancelled_and_replaced(spark, exception, owed):
    text = f"# TODO series\n`SCHEDULED: <2026-08-06 Thu +1w>`\n```org-properties\nID: s\n{exception or 'X: y'}\n```\n"
    found = entries(spark, text, "2026-08-24")
    assert found["2026-08-24", "overdue", "series"].days_offset == owed
    moved = text + "# TODO moved\n`SCHEDULED: <2026-08-22 Sat>`\n```org-properties\nSERIES_ID: s\nRECURRENCE_ID: 2026-08-20\n```\n# TODO lost\n`CREATED: [2026-01-01]`\n```org-properties\nSERIES_ID: t\nRECURRENCE_ID: 2026-08-20\n```\n"
    found = entries(spark, moved, "2026-08-24")
    assert found["2026-08-24", "overdue", "moved"].days_offset == -2 and ("2026-08-24", "overdue", "series") not in found
    assert [r.series_id for r in exceptions.unknown_series(planned(spark, moved)).collect()] == ["t"]


def test_list_order_sinks_and_envelope(spark, tmp_path):
    text = note(("TODO late", "<2024-12-05 Thu 14:00>"), ("TODO all", "<2024-12-05 Thu>"), ("TODO next", "<2024-12-06 Fri>"), ("TODO early", "<2024-12-05 Thu 09:30>"), ("TODO [#A] first", "<2030-01-01>"), ("DONE no", "<2024-01-01>"), ("CANCELLED no", "<2024-01-01>"))
    tasks = planned(spark, text)
    assert [r.heading for r in ag.flat_list(tasks).collect()] == ["first", "early", "late", "all", "next"]
    sinks.write_tasks(tasks, str(tmp_path / "tasks"))
    lines = [line for f in (tmp_path / "tasks").glob("part-*") for line in f.read_text().splitlines()]
    assert len(lines) == 7 and sum('"priority"' in x for x in lines) == 1
    found = ag.agenda(tasks, holidays.calendar(spark, "2024-01-01", "2025-12-31"), D("2024-12-05"), D("2024-12-06"), D("2024-12-05"))
    days = ag.envelopes(found, D("2024-12-04"), D("2024-12-06")).orderBy("day").collect()
    assert [len(d.scheduled_timed) for d in days] == [0, 2, 0] and [len(d.scheduled_no_time) for d in days] == [0, 1, 1] and all(d.overdue is None for d in days)


def test_next_occurrences(spark):
    rows = [("2026-07-21", 7, "d", None, "2026-07-28"), ("2026-01-15", 1, "m", None, "2026-08-15"), ("2026-07-24", 7, "d", "14:00", "2026-07-31"), ("2026-07-24", 7, "d", None, "2026-07-24"), ("2026-09-01", 1, "y", None, "2026-09-01")]
    df = spark.createDataFrame([(D(b), n, u, t, w, [], []) for b, n, u, t, w in rows], "base date, n long, unit string, timestamp_time string, want string, excluded_dates array<date>, replaced_dates array<date>")
    assert all(str(r.next_date) == r.want for r in ag.next_occurrences(df, D("2026-07-24"), "22:03").collect())
    early = ag.next_occurrences(df, D("2026-07-24"), "09:00").where("timestamp_time is not null").first()
    assert str(early.next_date) == "2026-07-24" and str(early.next_after) == "2026-07-31"


def test_series_before_the_calendar_and_end_times(spark):
    text = note(("TODO old", "SCHEDULED: <1950-01-02 Mon +1wd>"), ("TODO span", "SCHEDULED: <2025-12-05 Fri 09:10-10:20>"), ("TODO late", "SCHEDULED: <2025-12-01 Mon 09:10-10:20>"), ("TODO again", "SCHEDULED: <2025-12-01 Mon 09:10-10:20 +1d>"))
    found = entries(spark, text, "2025-12-05")
    day = "2025-12-05"
    assert (day, "scheduled_no_time", "old") in found
    assert found[day, "scheduled_timed", "span"].end_time == "10:20" and found[day, "overdue", "late"].end_time is None and found[day, "scheduled_timed", "again"].end_time is None


@pytest.mark.parametrize("size", [1, 2, 100])
def test_envelopes_in_parts_are_the_envelopes(spark, tmp_path, size):
    import json

    text = note(*[(f"TODO t{i}", f"SCHEDULED: <2025-12-0{3 + i % 3} Fri{' 09:30' * (i % 2)}>") for i in range(11)], ("TODO ahead", "DEADLINE: <2025-12-09 Tue>"))
    cal = holidays.calendar(spark, "2025-01-01", "2025-12-31")
    first, last = D("2025-12-02"), D("2025-12-05")
    found = ag.agenda(planned(spark, text), cal, first, last, D("2025-12-04")).persist()
    sinks.write_day_parts(ag.envelope_parts(found, first, last, size), str(tmp_path / "parts"))
    whole = "".join(f.read_text() for f in sorted((tmp_path / "parts").glob("part-*")))
    reader, days = json.JSONDecoder(), []
    while whole := whole.lstrip():
        day, at = reader.raw_decode(whole)
        days.append(day)
        whole = whole[at:]
    want = [json.loads(r) for r in ag.envelopes(found, first, last).orderBy("day").toJSON().collect()]
    assert days == want and [d["day"] for d in days] == ["2025-12-02", "2025-12-03", "2025-12-04", "2025-12-05"]
    assert ("overdue" in days[0], "overdue" in days[2]) == (False, True)


MIXED = note(
    ("TODO due", "DEADLINE: <2025-12-10 Wed -9d>"), ("TODO late", "SCHEDULED: <2025-11-29 Sat 9:00>"), ("TODO b [#B]", "SCHEDULED: <2025-12-05 Fri>"), ("TODO [#A] a", "SCHEDULED: <2025-12-05 Fri>"),
    ("TODO timed", "SCHEDULED: <2025-12-05 Fri 10:00-11:00>"), ("daily", "<2025-12-01 Mon 08:30 +2d>"), ("TODO weekly", "SCHEDULED: <2025-11-27 Thu +1w>"), ("TODO work", "DEADLINE: <2025-12-03 Wed +3wd>"),
)


def test_entries_move_no_row_and_agree_with_the_agenda(spark):
    work = ag.Workdays.listed()
    t, window = as_table(planned(spark, MIXED)), (D("2025-12-01"), D("2025-12-14"), D("2025-12-05"))
    ranked, plain = ag.agenda(t, work, *window), ag.entries(t, work, *window)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    names = plain.columns
    assert sorted(map(str, ranked.select(names).collect())) == sorted(map(str, plain.collect()))
    for (_, bucket), rows in _groups(ranked.collect()).items():
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        if bucket == "scheduled_timed":
            assert [r.time for r in rows] == sorted(r.time for r in rows)
    sizes = {r.day: r for r in ag.envelope_sizes(plain, *window[:2]).collect()}
    for r in ag.envelopes(ranked, *window[:2]).collect():
        assert [sizes[r.day][b] for b in ag.BUCKETS] == [len(r[b] or []) for b in ag.BUCKETS]


def _groups(rows):
    found = {}
    for r in rows:
        found.setdefault((r.day, r.bucket), []).append(r)
    return found


def test_cells_find_their_next_dates_without_a_join(spark):
    work = ag.Workdays.listed()
    t, window = planned(spark, MIXED), (D("2025-12-01"), D("2025-12-14"), D("2025-12-05"))
    joined = ag.with_next(ag.agenda(t, work, *window), t, work, window[2], "12:00")
    alone = ag.cells_with_next(t, work, *window, "12:00")
    assert "Join" not in alone.select("day")._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
    names = ["day", "bucket", "heading", "stamp", "timestamp_next", "timestamp_next_after"]
    assert sorted(map(str, joined.select(names).collect())) == sorted(map(str, alone.select(names).collect())) != []


def test_agendas_write_what_they_draw(spark, tmp_path):
    """Tasks that are neither drawn nor replace an occurrence are not written, nor are columns that no agenda reads."""
    import datetime

    from vesperline.plans import catalogue

    day = datetime.date(1998, 6, 1)
    orders = [(k, 1, day, "O", "1-URGENT") for k in range(1, 41)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, day, 3.0)], "l_orderkey long, l_linenumber int, l_shipdate date, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "S")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    whole, drawn = (f(spark, str(tmp_path)) for f in (catalogue._planned, catalogue._drawn))
    assert {"properties", "created"}.isdisjoint(drawn.columns)
    wanted = whole.where("(timestamp_active and base_date is not null) or (series_id is not null and recurrence_date is not null)")
    assert 0 < wanted.count() < whole.count()
    assert sorted(map(str, drawn.collect())) == sorted(map(str, wanted.select(drawn.columns).collect()))
