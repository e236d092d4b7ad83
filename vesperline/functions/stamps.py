"""Stamps in text: planning marks, dates, times, repeaters and warnings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, long forms first.
WEEKDAYS = [
    ("Понедельник", "Monday"), ("Вторник", "Tuesday"), ("Среда", "Wednesday"), ("Четверг", "Thursday"), ("Пятница", "Friday"), ("Суббота", "Saturday"),
    ("Воскресенье", "Sunday"), ("Пн", "Mon"), ("Вт", "Tue"), ("Ср", "Wed"), ("Чт", "Thu"), ("Пт", "Fri"), ("Сб", "Sat"), ("Вс", "Sun"),
]
#: Forms of dates and bracketed stamps, and the code points that brackets may hold after the date.
BODY = 256
_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_ANGLE = rf"<({_DATE}[^>]{{0,{BODY}}})>"
_SQUARE = rf"\[({_DATE}[^\]]{{0,{BODY}}})\]"
_DAYS = {"h": 1 / 24, "d": 1.0, "w": 7.0, "m": 30.4, "y": 365.25}


def _group(text: Column, pattern: str, n: int) -> Column:
    """A group that is never empty where the pattern meets, else null."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def english_weekdays(text: Column) -> Column:
    named = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), WEEKDAYS, text)
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(named)  # names are not ASCII


#: One pattern for all forms: a keyword with a single stamp, a range, a single stamp.
PLANNING = rf"(?U)^\s*(?:(?:(?:SCHEDULED|DEADLINE):\s*)?{_ANGLE}(?:--?-?{_ANGLE})?|(?:CLOSED:\s*)?{_SQUARE}(?:--?-?{_SQUARE})?)"
CREATED = rf"(?U)^\s*CREATED:\s*{_SQUARE}"


def may_open_with_stamp(text: Column) -> Column:
    """False only where a text begins with no stamp; clocks, the longest ones, do not."""
    return (text.contains("<") | text.contains("[")) & ~text.startswith("CLOCK:")


def planning_stamps(texts: Column) -> Column:
    """For each text the canonical stamp it begins with, or null: a keyword takes one stamp, without it a range has two."""
    found = F.transform(F.transform(texts, lambda t: F.when(~t.startswith("CREATED:"), F.regexp_substr(t, F.lit(PLANNING)))), lambda m: F.regexp_replace(m, r"(?U)^\s+", ""))

    def canonical(m: Column) -> Column:
        single = lambda end: F.concat(F.substring_index(m, end, 1), F.lit(end))
        angles, squares = F.regexp_replace(m, ">--?-?<", ">--<"), F.regexp_replace(m, r"\]--?-?\[", "]--[")
        return F.when(m.startswith("<"), angles).when(m.startswith("["), squares).when(m.startswith("C"), single("]")).otherwise(single(">"))

    return F.transform(found, canonical)


def created_stamps(texts: Column) -> Column:
    """For each text the creation stamp it begins with, or null."""
    found = F.transform(texts, lambda t: F.when(t.contains("CREATED:"), F.regexp_extract(t, CREATED, 1)))
    return F.transform(found, lambda m: F.when(m != "", F.concat(F.lit("CREATED: ["), m, F.lit("]"))))


def stamp_type(stamp: Column) -> Column:
    named = F.regexp_extract(stamp, r"^\s*(SCHEDULED|DEADLINE|CLOSED):", 1)
    return F.when(stamp.isNotNull(), F.when(named != "", named).otherwise("PLAIN"))


def is_active(stamp: Column) -> Column:
    angle, square = F.instr(stamp, "<"), F.instr(stamp, "[")
    return F.when((angle > 0) | (square > 0), (angle > 0) & ((square == 0) | (angle < square)))


#: Ranges, pairs of times, single times.
_RANGE = r"[<\[]([^>\]]*)[>\]]--?-?[<\[]([^>\]]*)[>\]]"
_PAIR, _ONE = r"\b([0-9]{1,2}:[0-9]{2})-([0-9]{1,2}:[0-9]{2})\b", r"\b([0-9]{1,2}:[0-9]{2})\b"


def stamp_date(stamp: Column) -> Column:
    return _group(stamp, rf"\b({_DATE})", 1)


def stamp_times(stamp: Column) -> tuple[Column, Column]:
    """(start, end): a stamp's own pair, else in a range the second stamp's start is the end."""
    ranged = stamp.rlike(_RANGE)
    first = F.when(ranged, F.regexp_extract(stamp, _RANGE, 1)).otherwise(stamp)
    return times_of(F.regexp_substr(first, F.lit(_PAIR)), first, F.when(ranged, F.regexp_extract(stamp, _RANGE, 2)))


def time_parts(stamp: Column) -> dict[str, Column]:
    """What ``times_of`` takes, but for the pair: the first stamp, and of a range the second one."""
    ranged = (stamp.contains(">-") | stamp.contains("]-")) & stamp.rlike(_RANGE)
    return {"_first": F.when(ranged, F.regexp_extract(stamp, _RANGE, 1)).otherwise(stamp), "_second": F.when(ranged, F.regexp_extract(stamp, _RANGE, 2))}


def times_of(pair: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """(start, end) from a stamp's pair of times, itself, and the second stamp of a range."""
    later = F.when(second.isNotNull(), F.coalesce(_group(second, _PAIR, 1), _group(second, _ONE, 1)))
    start = F.when(pair.isNotNull(), F.substring_index(pair, "-", 1)).otherwise(_group(first, _ONE, 1))
    return start, F.when(pair.isNotNull(), F.substring_index(pair, "-", -1)).otherwise(later)


def time_pair(first: Column) -> Column:
    return F.regexp_substr(first, F.lit(_PAIR))


def real_date(text: Column) -> Column:
    """A calendar date written in full, else null."""
    return F.when(text.rlike(rf"^{_DATE}$"), text.try_cast("date"))


def _bracket_body(stamp: Column) -> Column:
    return F.regexp_extract(stamp, r"[<\[]([^>\]]*)[>\]]", 1)


#: The forms of a repeater; a leading plus too many is read as the number's own sign.
_REPEATER, _PARTS = r"([.+]+[0-9]+(?:wd|[dwmyh]))", r"^(\+\+|\.\+|\+)\+?([0-9]+)(wd|[dwmyh])$"


def repeater_token(stamp: Column) -> Column:
    """The text of a stamp's repeater; empty where it has none."""
    return F.when(stamp.contains("+"), F.regexp_extract(_bracket_body(stamp), _REPEATER, 1)).when(stamp.isNotNull(), "")


def repeater_number(token: Column) -> Column:
    """A repeater's number; null where the text is none."""
    return F.when(token != "", F.regexp_extract(token, _PARTS, 2).try_cast("bigint"))


def repeater_of(token: Column, n: Column, base: Column) -> Column:
    """``struct(kind, n, unit)`` of a repeater's text and number on a real date, else null."""
    ok = n.between(1, 4294967295) & base.isNotNull()
    return F.when(ok, F.struct(F.regexp_extract(token, _PARTS, 1).alias("kind"), n.alias("n"), F.regexp_extract(token, _PARTS, 3).alias("unit")))


def repeater(stamp: Column) -> Column:
    """``struct(kind, n, unit)`` or null; a stamp whose date does not exist has none."""
    token = repeater_token(stamp)
    return repeater_of(token, repeater_number(token), real_date(stamp_date(stamp)))


def repeater_text(rep: Column) -> Column:
    return F.when(rep.isNotNull(), F.concat(rep["kind"], rep["n"].cast("string"), rep["unit"]))


def warning_days(stamp: Column) -> Column:
    """The lead time of a `` -N[hdwmy]`` mark in whole days."""
    p = r"(?U)\s-([0-9]+)([hdwmy])(?:[\s>\]]|$)"
    n, unit = F.regexp_extract(stamp, p, 1).try_cast("bigint"), F.regexp_extract(stamp, p, 2)
    factor = reduce(lambda c, kv: F.when(unit == kv[0], kv[1]).otherwise(c), _DAYS.items(), F.lit(None).cast("double"))
    return F.when(stamp.rlike(p), F.floor(n * factor).cast("bigint"))


def priority_order(priority: Column) -> Column:
    number = F.when(priority.rlike("^[0-9]+$"), priority.try_cast("bigint"))
    return F.coalesce(number, F.when(priority.isNotNull(), F.ascii(priority).cast("bigint")), F.lit(4294967295))
