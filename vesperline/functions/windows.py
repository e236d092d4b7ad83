"""Days, weeks, months and grids: which dates an agenda covers. Scalars only, resolved before planning."""

from __future__ import annotations

from calendar import monthrange
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
SCOPES = ("day", "week", "month", "month-grid", "tasks")


def week_of(d: Column, first_weekday: int = 0) -> Column:
    """The first day of the week of a date; weeks begin on ``first_weekday`` (Monday is 0)."""
    return F.date_sub(d, F.pmod(F.weekday(d) - F.lit(first_weekday), F.lit(7)))


def parse_day(text: str) -> date:
    found = date.fromisoformat(text)
    if not 1900 <= found.year <= 2100:
        raise ValueError(f"{text} is not between 1900 and 2100")
    return found


def week_start_of(name: str | None) -> int | None:
    """A weekday's number; None for a week anchored on its own first day."""
    if name == "anchor":
        return None
    if (name or "monday").lower() not in WEEKDAYS:
        raise ValueError(f"not a weekday: {name}")
    return WEEKDAYS.index((name or "monday").lower())


def window(scope: str, current: date, day: str | None = None, first: str | None = None, last: str | None = None, week_start: str | None = None) -> tuple[date, date] | None:
    """(first day, last day) of a scope. An explicit range wins over a date, a date over the current one; a missing
    edge is the current date. The flat list takes no dates and has no window."""
    if scope not in SCOPES:
        raise ValueError(f"not a scope: {scope}")
    if scope == "tasks":
        if day or first or last:
            raise ValueError("the flat list takes no dates")
        return None
    start_of_week = week_start_of(week_start)
    if scope == "month-grid" and start_of_week is None:
        raise ValueError("a grid needs a weekday to begin on")
    back = lambda d: d - timedelta((d.weekday() - start_of_week) % 7)
    if first or last:
        a, b = (parse_day(x) if x else current for x in (first, last))
        if a > b:
            raise ValueError("the range ends before it begins")
        return (back(a), back(b) + timedelta(6)) if scope == "month-grid" else (a, b)
    at = parse_day(day) if day else current
    if scope == "day":
        return at, at
    if scope == "week":
        a = at if start_of_week is None else back(at)
        return a, a + timedelta(6)
    a, b = at.replace(day=1), at.replace(day=monthrange(at.year, at.month)[1])
    return (back(a), back(b) + timedelta(6)) if scope == "month-grid" else (a, b)


def now_in(zone: str, pinned: str | None = None) -> tuple[date, str]:
    """(current date, time of day) in a zone; a pinned date is at its midnight. An unknown zone is refused."""
    try:
        here = datetime.now(ZoneInfo(zone))
    except (KeyError, ValueError, OSError) as e:
        raise ValueError(f"not a time zone: {zone!r}") from e
    return (parse_day(pinned), "00:00") if pinned else (here.date(), here.strftime("%H:%M"))


def day_in(moment: Column, zone: str) -> Column:
    """The date of a moment in UTC as a zone's calendars show it."""
    return F.from_utc_timestamp(moment, zone).cast("date")
