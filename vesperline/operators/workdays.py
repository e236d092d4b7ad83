"""Working-day arithmetic over rows: expressions only, so a row stays where it is whatever its dates.

``calendar`` is a ``Workdays``, or a day-by-day table whose exceptions are read once; every other day is a working day from
Monday to Friday.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesperline.functions import recurrence as rec
from vesperline.functions.working_days import Workdays


def workdays_between(pairs: DataFrame, calendar: Workdays | DataFrame, start: str, end: str) -> DataFrame:
    """``pairs`` with the number of workdays in (start, end]; 0 where end is not later, null where a date is."""
    work = Workdays.of(calendar)
    return pairs.withColumn("workdays", F.expr(f"case when {end} > {start} then {work.ordinal(end)} - {work.ordinal(start)} when {end} <= {start} then 0L end"))


def nth_workday(rows: DataFrame, calendar: Workdays | DataFrame, start: str, n: str) -> DataFrame:
    """``rows`` with the n-th workday after a date; 0 is the date itself; null past the last date there is."""
    work = Workdays.of(calendar)
    return rows.withColumn("nth_day", F.expr(f"case when {n} = 0 then {start} else {work.day(f'{work.ordinal(start)} + {n}')} end"))


def bracket(series: DataFrame, calendar: Workdays | DataFrame, day: str = "c") -> DataFrame:
    """``series(base, n, ...)`` with ``n1`` (last occurrence at or before the day, for days from the base on) and
    ``n2`` (the first after it)."""
    near = F.expr(rec._grid("base", "n", "'wd'", f"greatest({day}, base)", "0L", "0L", Workdays.of(calendar)))
    out = series.withColumn("_near", near)
    n1 = F.expr(f"array_max(filter(_near, d -> d <= greatest({day}, base)))")
    return out.withColumns({"n1": n1, "n2": F.expr(f"array_min(filter(_near, d -> d > greatest({day}, base)))")}).drop("_near")


def occurrences(series: DataFrame, calendar: Workdays | DataFrame, first: str, last: str) -> DataFrame:
    """One row (``day``) for each working-day occurrence in the window."""
    days = rec.occurrences("base", "n", "'wd'", f"date'{first}'", f"date'{last}'", Workdays.of(calendar))
    return series.withColumn("day", F.explode(days))
