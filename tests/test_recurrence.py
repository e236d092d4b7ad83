import calendar
import datetime as dt
import random

import pytest

from vesperline.functions import recurrence as rec
from vesperline.functions import windows
from vesperline.operators import workdays
from vesperline.sources import holidays

D = dt.date.fromisoformat


def months_on(d, k):
    m = d.year * 12 + d.month - 1 + k
    y, m = divmod(m, 12)
    return dt.date(y, m + 1, min(d.day, calendar.monthrange(y, m + 1)[1]))


def grid(base, n, unit, last):
    """Generated one by one."""
    k = 0
    while True:
        if unit in "dwh":
            d = base + dt.timedelta(k * {"d": n, "w": 7 * n, "h": 1}[unit])
        elif unit == "m":
            d = months_on(base, k * n)
        else:
            year = base.year + k * n
            d = None if (base.month, base.day) == (2, 29) and not calendar.isleap(year) else base.replace(year=year)
        k += 1
        if d is None:
            continue
        if d > last:
            yield d
            return
        yield d


def test_golden_closest(spark):
    rows = [
        ("2024-02-29", 1, "y", "2025-03-01", "2024-02-29", "2028-02-29"), ("2024-01-31", 1, "m", "2024-04-15", "2024-03-31", "2024-04-30"),
        ("2024-01-31", 1, "m", "2024-05-01", "2024-04-30", "2024-05-31"), ("2024-01-31", 3, "m", "2024-04-15", "2024-01-31", "2024-04-30"),
        ("2025-01-01", 10, "y", "2025-12-05", "2025-01-01", "2035-01-01"), ("2020-01-01", 99999999, "d", "2026-07-25", None, None),
        ("2020-01-01", 99999999, "w", "2026-07-25", None, None), ("2026-07-21", 7, "d", "2026-07-01", None, "2026-07-21"), ("2026-07-21", 7, "d", "2026-07-21", "2026-07-21", "2026-07-21"),
    ]
    df = spark.createDataFrame([(i, D(b), n, u, D(c)) for i, (b, n, u, c, _, _) in enumerate(rows)], "i int, base date, n long, unit string, c date")
    for r in rec.with_closest(df, "c").collect():
        want = rows[r.i][4:]
        assert (r.past and str(r.past), r.future and str(r.future)) == want, rows[r.i]


def test_closed_forms_equal_generated_grids(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        base = dt.date(2019, 1, 1) + dt.timedelta(rng.randrange(2500))
        if i % 10 == 0:
            base = rng.choice((dt.date(2020, 2, 29), dt.date(2021, 1, 31), dt.date(2024, 12, 31)))
        rows.append((i, base, rng.randrange(1, 9), rng.choice("dwhmy"), base + dt.timedelta(rng.randrange(-200, 4000))))
    df = rec.with_closest(spark.createDataFrame(rows, "i int, base date, n long, unit string, c date"), "c")
    lo, hi = "2022-03-01", "2024-05-31"
    df = df.withColumn("days", rec.occurrences("base", "n", "unit", f"date'{lo}'", f"date'{hi}'"))
    for r in df.collect():
        dates = list(grid(r.base, r.n, r.unit, max(r.c, D(hi))))
        assert r.past == max((d for d in dates if d <= r.c), default=None) and r.future == min(d for d in dates if d >= r.c), r
        assert sorted(r.days) == [d for d in dates if D(lo) <= d <= D(hi)], r


def test_missing_occurrences(spark):
    base, week = D("2026-08-06"), dt.timedelta(7)
    rows = [(0, [D("2026-08-20")], [], D("2026-08-24")), (1, [], [D("2026-08-20")], D("2026-08-24")), (2, [base + k * week for k in range(3)], [], D("2026-08-06"))]
    df = spark.createDataFrame([(i, base, 1, "w", x, r, c) for i, x, r, c in rows], "i int, base date, n long, unit string, x array<date>, r array<date>, c date")
    from pyspark.sql import functions as F

    back = rec.candidates("base", "n", "unit", "c", "size(x) + size(r) + 1", ahead=False)
    ahead = rec.candidates("base", "n", "unit", "c", "size(x) + size(r) + 1", ahead=True)
    got = df.select("i", rec.owed(back, F.col("x"), F.col("r")).alias("owed"), rec.next_standing(ahead, F.col("x"), F.col("r")).alias("next")).orderBy("i").collect()
    assert [(r.owed and str(r.owed), str(r.next)) for r in got] == [("2026-08-13", "2026-08-27"), (None, "2026-08-27"), (None, "2026-08-27")]


def test_workdays_equal_a_day_walk(spark):
    cal = holidays.calendar(spark, "2025-12-01", "2027-12-31").persist()
    works = {r.d: r.is_workday for r in cal.collect()}
    for off in ("2026-01-09", "2026-03-09", "2026-05-11"):
        assert not works[D(off)]
    assert works[D("2026-01-12")]
    rng = random.Random(2)
    rows = [(i, dt.date(2026, 1, 1) + dt.timedelta(rng.randrange(200)), rng.randrange(1, 6)) for i in range(120)]
    rows = [(i, b, n, b + dt.timedelta(rng.randrange(0, 150))) for i, b, n in rows]
    df = spark.createDataFrame(rows, "i int, base date, n long, c date")

    def walk(b, n, count):
        while count:
            b += dt.timedelta(1)
            count -= works[b]
        return b

    for r in workdays.bracket(df, cal).collect():
        n1, k = r.base, 0
        while (after := walk(r.base, r.n, (k + 1) * r.n)) <= r.c:
            n1, k = after, k + 1
        assert (r.n1, r.n2) == (n1, walk(n1, r.n, r.n)), r
    pair = spark.createDataFrame([(D("2025-12-07"), D("2025-12-12")), (D("2025-12-12"), D("2025-12-07"))], "s date, e date")
    assert sorted(r.workdays for r in workdays.workdays_between(pair, cal, "s", "e").collect()) == [0, 5]
    with pytest.raises(Exception):
        holidays.listed_days(spark, '{"2025": {"holidays": ["2025-02-30"], "workdays": []}}').collect()


def test_windows():
    w = lambda *a, **b: tuple(str(x) for x in windows.window(*a, **b))
    aug = D("2026-08-15")
    assert w("month-grid", aug) == ("2026-07-27", "2026-09-06") and w("month-grid", aug, week_start="sunday") == ("2026-07-26", "2026-09-05")
    assert w("month-grid", D("2027-02-10")) == ("2027-02-01", "2027-02-28")
    assert w("month-grid", aug, first="2026-08-05", last="2026-08-11", week_start="sunday") == ("2026-08-02", "2026-08-15")
    assert w("week", aug, first="2026-08-01") == ("2026-08-01", "2026-08-15") and w("week", aug, last="2026-08-20") == ("2026-08-15", "2026-08-20")
    assert w("week", D("2026-05-21")) == ("2026-05-18", "2026-05-24") and w("week", D("2026-05-21"), week_start="anchor") == ("2026-05-21", "2026-05-27")
    for bad in (dict(scope="tasks", day="2026-01-01"), dict(scope="week", first="2026-09-01"), dict(scope="month-grid", week_start="anchor"), dict(scope="day", day="1800-01-01")):
        with pytest.raises(ValueError):
            windows.window(current=aug, **bad)


def test_working_days_of_any_year_equal_a_day_walk(spark):
    from vesperline.functions.working_days import Workdays

    work = Workdays.listed()
    off = {x for x in work._days if work._sums[work._days.index(x) + 1] < work._sums[work._days.index(x)]}
    days = lambda d: (d - dt.date(1970, 1, 1)).days
    works = lambda d: (d.weekday() < 5) if days(d) not in work._days else days(d) not in off
    rng = random.Random(8)
    rows = []
    for i, year in enumerate([1900, 1969, 1970, 2025, 2026, 2027, 2100, 9000] * 12):
        base = dt.date(year, 1, 1) + dt.timedelta(rng.randrange(365))
        rows.append((i, base, rng.randrange(1, 8), base + dt.timedelta(rng.randrange(0, 90))))
    df = spark.createDataFrame(rows + [(1000, None, 2, D("2026-01-01"))], "i int, base date, n long, c date")
    for rules in (work, Workdays(), Workdays([D("2026-01-05")], [D("2026-01-04"), D("2026-01-10")])):
        if rules is not work:
            changed = {D("2026-01-05"): False, D("2026-01-04"): True, D("2026-01-10"): True} if rules._days else {}
            works = lambda d: changed.get(d, d.weekday() < 5)  # noqa: E731, B023
        got = workdays.bracket(workdays.workdays_between(workdays.nth_workday(df, rules, "base", "n"), rules, "base", "c"), rules).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            if r.base is None:
                assert (r.workdays, r.nth_day, r.n1, r.n2) == (None, None, None, None)
                continue
            found, d = [], r.base
            while len(found) < 200:
                d += dt.timedelta(1)
                if works(d):
                    found.append(d)
            grid = [r.base, *found[r.n - 1 :: r.n]]
            assert (r.workdays, r.nth_day) == (sum(d <= r.c for d in found), found[r.n - 1])
            assert (r.n1, r.n2) == (max(d for d in grid if d <= r.c), min(d for d in grid if d > r.c)), r


def test_a_series_of_very_many_exceptions(spark):
    import time

    from vesperline.operators import agenda as ag

    base, n = D("1990-01-01"), 100_000
    out = [base + dt.timedelta(k) for k in range(n)]
    rows = [(1, base, 1, "d", None, out, []), (2, base, 1, "wd", None, out[: n // 2], out[n // 2 :]), (3, base, 1, "w", None, out[:-7], [])]
    df = spark.createDataFrame(rows, "i int, base date, n long, unit string, timestamp_time string, excluded_dates array<date>, replaced_dates array<date>").persist()
    df.count()
    began = time.perf_counter()
    from vesperline.functions.working_days import Workdays

    got = {r.i: r.next_date for r in ag.next_occurrences(df, D("2020-01-01"), calendar=Workdays()).collect()}
    owed = {r.i: r.owed_date for r in ag.arrears(df, D("2500-01-01"), Workdays()).collect()}
    assert time.perf_counter() - began < 60
    end = base + dt.timedelta(n)
    assert got[1] == end and got[2] >= end and got[2].weekday() < 5 and got[3] == next(base + dt.timedelta(7 * k) for k in range(n) if base + dt.timedelta(7 * k) >= end - dt.timedelta(7))
    assert owed[1] == D("2500-01-01") and owed[2] == D("2500-01-01")


def test_listed_days_are_checked():
    from vesperline.functions.working_days import Workdays

    for bad in ('{"2025": {"holidays": ["2025-02-30"]}}', '{"2025": {"holidays": ["2026-01-01"]}}'):
        with pytest.raises(ValueError):
            Workdays.listed(bad)
    both = Workdays.listed('{"_note": {}, "2025": {"holidays": ["2025-03-03", "2025-03-08"], "workdays": ["2025-03-03", "2025-03-01"]}}')
    assert both.works_on(D("2025-03-03")) and both.works_on(D("2025-03-01")) and not both.works_on(D("2025-03-08"))
