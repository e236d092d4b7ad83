"""Recurrence arithmetic as SQL expressions over columns: closed forms, no walking.

A grid is a base date, a step ``n`` and a unit: d, w, h (a day each, the step is not used), m, y, and wd where the working
days are given. Arguments are SQL column expressions; ``n`` is a bigint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperline.functions.working_days import Workdays, let

_LAST_DAY = 2932896  # 9999-12-31 in days since 1970


def _step(n: str, u: str) -> str:
    return f"(case {u} when 'd' then {n} when 'w' then 7 * {n} else 1L end)"


def _months(d: str) -> str:
    return f"(cast(year({d}) as bigint) * 12 + month({d}) - 1)"


def _day(base: str, days: str) -> str:
    return f"(case when unix_date({base}) + ({days}) between -719162 and {_LAST_DAY} then date_from_unix_date(cast(unix_date({base}) + ({days}) as int)) end)"


def _month(base: str, k: str) -> str:
    return f"(case when {_months(base)} + ({k}) between 12 and 119999 then add_months({base}, cast({k} as int)) end)"


def _year(base: str, k: str) -> str:
    """The base's day ``k`` years on; null for a 29 February that does not exist."""
    moved = _month(base, f"12L * ({k})")
    return f"(case when day({moved}) = day({base}) then {moved} end)"


def _grid(base: str, n: str, u: str, at: str, before: str, after: str, work: Workdays | None = None) -> str:
    """SQL of the grid dates around ``at`` (not before the base): ``before`` and ``after`` steps and one more each way.

    The index of the step at ``at`` is a quotient, so nothing is walked. A yearly 29 February looks further, for most
    of its years lack it.
    """
    s = _step(n, u)
    reach = f"(case when month({base}) = 2 and day({base}) = 29 then 200L else 1L end)"

    def part(k: str, wide: str, date) -> str:
        lo, hi = f"greatest(0L, {k} - {wide} - ({before}))", f"greatest(0L, {k} + {wide} + ({after}))"
        return f"transform(sequence({lo}, {hi}), k -> {date})"

    days = part(f"(cast(datediff({at}, {base}) as bigint) div {s})", "1", _day(base, f"k * {s}"))
    months = part(f"(({_months(at)} - {_months(base)}) div {n})", "1", _month(base, f"k * {n}"))
    years = part(f"((year({at}) - year({base})) div {n})", reach, _year(base, f"k * {n}"))
    working = ""
    if work is not None:  # the base is on its grid, whether it is a working day or not
        step = lambda o: part(f"(({work.ordinal(at)} - {o}) div {n})", "1", f"case when k = 0 then {base} else {work.day(f'{o} + k * {n}')} end")
        working = f"when {u} = 'wd' then {let(work.ordinal(base), step)}"
    return f"coalesce(case when {u} in ('d','w','h') then {days} when {u} = 'm' then {months} when {u} = 'y' then {years} {working} end, cast(array() as array<date>))"


def with_closest(series: DataFrame, day: str, work: Workdays | None = None) -> DataFrame:
    """``series(base, n, unit, ...)`` with ``past`` and ``future``: the grid date at or before the day and the one at or
    after it. Before the base there is no past; off the calendar's end there is neither."""
    near = series.withColumn("_near", F.expr(_grid("base", "n", "unit", f"greatest({day}, base)", "0L", "0L", work)))
    near = near.withColumn("_n1", F.expr(f"array_max(filter(_near, d -> d <= greatest({day}, base)))")).withColumn("_n2", F.expr(f"array_min(filter(_near, d -> d > greatest({day}, base)))"))
    past = f"case when {day} < base then null when {day} = base then base when _n2 is not null then _n1 end"
    future = f"case when {day} <= base then base when _n2 is null then null when _n1 = {day} then _n1 else _n2 end"
    return near.withColumns({"past": F.expr(past), "future": F.expr(future)}).drop("_near", "_n1", "_n2")


def occurrences(base: str, n: str, u: str, first: str, last: str, work: Workdays | None = None) -> Column:
    """All grid dates in [first, last], made from the window's edges and never from the base on."""
    s = _step(n, u)
    steps = f"(datediff({last}, greatest({first}, {base})) div (case {u} when 'm' then 28 * {n} when 'y' then 365 * {n} when 'wd' then {n} else {s} end) + 1)"
    return F.expr(f"case when {last} >= {base} then filter({_grid(base, n, u, f'greatest({first}, {base})', '0L', steps, work)}, d -> d between {first} and {last}) else cast(array() as array<date>) end")


def candidates(base: str, n: str, u: str, c: str, missing: str, ahead: bool, work: Workdays | None = None) -> Column:
    """The grid dates from ``c`` on (or back from it): more than ``missing`` of them, so that one must stand."""
    at, many = f"greatest({c}, {base})", f"cast({missing} as bigint)"
    if ahead:
        return F.expr(f"filter({_grid(base, n, u, at, '0L', many, work)}, d -> d >= {c})")
    return F.expr(f"filter({_grid(base, n, u, at, many, '0L', work)}, d -> d <= {c})")


def standing(grid: Column, cancelled: Column, replaced: Column) -> Column:
    """The candidates that are neither cancelled nor replaced: a difference of sets, so the work is in proportion to all
    three however many exceptions a series has."""
    return F.array_except(grid, F.concat(cancelled, replaced))


def next_standing(grid: Column, cancelled: Column, replaced: Column) -> Column:
    """The first candidate that is neither cancelled nor replaced."""
    return F.array_min(standing(grid, cancelled, replaced))


def owed(grid: Column, cancelled: Column, replaced: Column) -> Column:
    """Arrears: the last candidate not merely cancelled; nothing is owed where that one was replaced."""
    last = F.array_max(F.array_except(grid, F.array_except(cancelled, replaced)))
    return F.when(~F.array_contains(replaced, last), last)


def with_occurrences(series: DataFrame, first: str, last: str, work: Workdays | None = None) -> DataFrame:
    """One row for each occurrence of ``series(base, n, unit, ...)`` in a window of dates given as text."""
    return series.withColumn("day", F.explode(occurrences("base", "n", "unit", f"date'{first}'", f"date'{last}'", work)))
