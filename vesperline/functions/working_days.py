"""Working days in closed form: a count of weekdays by arithmetic, corrected by a search in the listed exceptions.

A calendar is only its exceptions: holidays that fall on weekdays, and working days at weekends. They are a list of a few
hundred days and travel in the plan as sorted arrays; a day's ordinal and an ordinal's day are expressions over them, for
any date, so nothing is joined and no date lies off the calendar.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from datetime import date, timedelta
from functools import cached_property
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = date(1970, 1, 1)
_FIRST, _LAST = -719162, 2932896  # 0001-01-01 and 9999-12-31 in days since 1970
_names = iter(range(1 << 62))


def let(value: str, body) -> str:
    """SQL of ``body(name)`` with the value computed once."""
    name = f"v{next(_names)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _weekdays(days: int) -> int:
    """Weekdays from Monday, 1969-12-29, up to a day, given as days since 1970."""
    weeks, rest = divmod(days + 3, 7)
    return 5 * weeks + min(rest + 1, 5)


class Workdays:
    """The exceptions of a calendar, and SQL expressions of what they mean for a date."""

    def __init__(self, off: list[date] = (), on: list[date] = ()):
        extra = {(d - _EPOCH).days for d in on}
        shift = {x: 1 for x in extra if (x + 3) % 7 >= 5} | {x: -1 for d in off if (x := (d - _EPOCH).days) not in extra and (x + 3) % 7 < 5}
        self._days = sorted(shift)
        sums, total = [0], 0
        for x in self._days:
            total += shift[x]
            sums.append(total)
        self._sums = sums  # of the exceptions before each place
        self._ordinals = [_weekdays(x) + sums[k + 1] for k, x in enumerate(self._days)]

    @classmethod
    def listed(cls, json_text: str | None = None) -> Workdays:
        """From the packaged list, or one of its form. Keys that begin with ``_`` are skipped; a date that does not exist
        or stands under another year is refused. A listed working day wins over a listed holiday."""
        years = json.loads(json_text or files("vesperline.sources").joinpath("holidays.json").read_text("utf-8"))
        days: dict[str, list[date]] = {"holidays": [], "workdays": []}
        for year, lists in years.items():
            for kind in days if not year.startswith("_") else ():
                for text in lists.get(kind) or ():
                    if not text.startswith(f"{year}-"):
                        raise ValueError(f"a date outside its year: {text}")
                    days[kind].append(date.fromisoformat(text))
        return cls(days["holidays"], days["workdays"])

    @classmethod
    def of(cls, calendar: Workdays | DataFrame) -> Workdays:
        """From itself, or from the exceptions of a day-by-day table ``(d, is_workday)``."""
        if isinstance(calendar, cls):
            return calendar
        odd = calendar.where(F.col("is_workday") != (F.weekday("d") < 5)).select("d", "is_workday").collect()
        return cls([r.d for r in odd if not r.is_workday], [r.d for r in odd if r.is_workday])

    # --- on the driver ---

    def ordinal_of(self, d: date) -> int:
        days = (d - _EPOCH).days
        return _weekdays(days) + self._sums[bisect_right(self._days, days)]

    def works_on(self, d: date) -> bool:
        return self.ordinal_of(d) > self.ordinal_of(d - timedelta(1))

    # --- as SQL ---

    @cached_property
    def _steps(self) -> str:
        """Halving steps of a binary search."""
        steps = [1 << b for b in range(len(self._days).bit_length() - 1, -1, -1)]
        return f"array({', '.join(map(str, steps))})"

    def _before(self, values: list[int], x: str, strict: bool) -> str:
        """How many of sorted values are below ``x``, or equal to it unless strict."""
        if not values:
            return "0"
        listed, meets = f"array({', '.join(f'{v}L' for v in values)})", "<" if strict else "<="
        p, s = f"p{next(_names)}", f"s{next(_names)}"
        return f"aggregate({self._steps}, 0, ({p}, {s}) -> case when {p} + {s} <= {len(values)} and element_at({listed}, {p} + {s}) {meets} {x} then {p} + {s} else {p} end)"

    def _sum_at(self, place: str) -> str:
        return f"element_at(array({', '.join(f'{v}L' for v in self._sums)}), {place} + 1)"

    def ordinal(self, d: str) -> str:
        """The number of working days up to a date, counted from 1969-12-29 on, before it in negative numbers."""

        def counted(t: str) -> str:
            plain = f"({t} + 3 - pmod({t} + 3, 7L)) div 7 * 5 + least(pmod({t} + 3, 7L) + 1, 5L)"
            return f"{plain} + {self._sum_at(self._before(self._days, t, False))}" if self._days else plain

        return let(f"cast(unix_date({d}) as bigint)", counted)

    def day(self, ordinal: str) -> str:
        """The first date with an ordinal; null past the end of dates."""

        def found(o: str) -> str:
            first = lambda x: f"(({x}) - 1 - pmod(({x}) - 1, 5L)) div 5 * 7 + pmod(({x}) - 1, 5L) - 3"
            if not self._days:
                return let(first(o), self._date)
            # the exceptions whose ordinal is lower lie before the day; the next one may be the day itself
            after = f"array({', '.join(f'{x}L' for x in [*self._days, 1 << 40])})"
            nearest = lambda p: f"case when {o} is not null then least({first(f'{o} - {self._sum_at(p)}')}, element_at({after}, {p} + 1)) end"
            return let(self._before(self._ordinals, o, True), lambda p: let(nearest(p), self._date))

        return let(f"cast({ordinal} as bigint)", found)

    @staticmethod
    def _date(days: str) -> str:
        return f"case when {days} between {_FIRST} and {_LAST} then date_from_unix_date(cast({days} as int)) end"

    def works(self, d: str) -> str:
        return f"({self.ordinal(d)} > {self.ordinal(f'date_sub({d}, 1)')})"

    # --- as columns ---

    def is_workday(self, name: str) -> Column:
        return F.expr(self.works(name))
