"""Agendas: tasks by day in four ordered buckets, and the flat list."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperline.functions import recurrence as rec
from vesperline.functions.working_days import Workdays
from vesperline.operators.ranking import numbered, ranked
from vesperline.sources.scratch import as_table

#: Days of warning before a deadline, and what has no priority.
WARNING_DAYS, NO_PRIORITY = 14, 4294967295
BUCKETS = ("overdue", "scheduled_timed", "scheduled_no_time", "upcoming")


def flat_list(tasks: DataFrame, done: bool = False, cancelled: bool = False, limit: int | None = None) -> DataFrame:
    """Open tasks with their ``position`` in list order; done and cancelled ones are asked for apart. With a limit, the
    first ones in that order."""
    states = ["TODO"] + ["DONE"] * done + ["CANCELLED", "CANCELED"] * cancelled
    order = [F.col("priority_order"), F.col("timestamp_date").asc_nulls_last(), F.col("timestamp_time").asc_nulls_last(), F.col("root"), F.col("file"), F.col("line")]
    kept = tasks.where(F.col("task_type").isin(states))
    return ranked(kept, [], order, "position") if limit is None else kept.orderBy(*order).limit(limit)


def _lasting() -> Column:
    return F.coalesce(F.col("timestamp_type").isin("SCHEDULED", "DEADLINE") & (F.coalesce("task_type", F.lit("")) != "DONE"), F.lit(False))


def series_of(tasks: DataFrame) -> DataFrame:
    """Active stamps on real dates, with their grid and the dates missing from it."""
    return tasks.where("timestamp_active and base_date is not null").select(
        "*", F.col("base_date").alias("base"), F.col("rep.n").alias("n"), F.col("rep.unit").alias("unit")
    )


def cell_stamp(kind: Column, day: Column, time: Column, rep: Column) -> Column:
    """A series' stamp as drawn on a day: end time and warning are left out."""
    clock = F.when(time.isNotNull(), F.concat(F.lit(" "), time)).otherwise("")
    return F.concat(kind, F.lit(": <"), day.cast("string"), F.lit(" "), F.date_format(day, "EEE"), clock, F.lit(" "), rep, F.lit(">"))


_MISSING = "size(excluded_dates) + size(replaced_dates) + 1"


def _ends(series: DataFrame, current: date, work: Workdays) -> DataFrame:
    """``owed_date`` (arrears at the current date) and ``first_standing`` (from the base on) of series.

    Both look at as many grid dates as may be missing, one more, and no others.
    """
    back = rec.candidates("base", "n", "unit", f"date'{current.isoformat()}'", _MISSING, ahead=False, work=work)
    ahead = rec.candidates("base", "n", "unit", "base", _MISSING, ahead=True, work=work)
    return series.withColumns({
        "owed_date": rec.owed(back, F.col("excluded_dates"), F.col("replaced_dates")), "first_standing": rec.next_standing(ahead, F.col("excluded_dates"), F.col("replaced_dates")),
    })


_TASK = ["root", "file", "line", "heading", "task_type", "priority", "timestamp_type"]
#: The columns of tasks that an agenda reads besides the dates missing from their series.
NEEDED = [*_TASK, "priority_order", "timestamp", "timestamp_time", "timestamp_end_time", "timestamp_repeater", "rep", "warning_days"]
_SHOWN = ["day", "bucket", "date", "time", "end_time", "stamp", "days_offset"]


def _days(first: date, last: date, work: Workdays) -> Column:
    """The days of a window on which a row of ``series_of`` is drawn."""
    lo, hi = (F.lit(x.isoformat()).cast("date") for x in (first, last))
    days = rec.standing(rec.occurrences("base", "n", "unit", f"date'{first}'", f"date'{last}'", work), F.col("excluded_dates"), F.col("replaced_dates"))
    return F.when(F.col("rep").isNotNull(), days).when(F.col("base").between(lo, hi), F.array("base"))


def _timed() -> Column:
    return F.when(F.col("timestamp_time").isNotNull(), "scheduled_timed").otherwise("scheduled_no_time")


def _cells(series: DataFrame, first: date, last: date, work: Workdays, *more: str) -> DataFrame:
    """A row for each day on which a row of ``series_of`` is drawn."""
    rows = series.select(*_TASK, "timestamp", "timestamp_time", "timestamp_end_time", "timestamp_repeater", "rep", *more, F.explode(_days(first, last, work)).alias("day"))
    cell = F.when(F.col("timestamp_type").isNotNull(), cell_stamp(F.col("timestamp_type"), F.col("day"), F.col("timestamp_time"), F.col("timestamp_repeater")))
    single = F.col("rep").isNull()
    return rows.select(
        *_TASK, "day", _timed().alias("bucket"), F.col("day").alias("date"), F.col("timestamp_time").alias("time"), F.when(single, F.col("timestamp_end_time")).alias("end_time"),
        F.when(single, F.col("timestamp")).otherwise(cell).alias("stamp"), F.lit(None).cast("int").alias("days_offset"), *more,
    )


def _due(series: DataFrame, current: date, work: Workdays) -> DataFrame:
    """The overdue and upcoming entries of the current date."""
    today = F.lit(current.isoformat()).cast("date")
    deadline = F.coalesce(F.col("timestamp_type") == "DEADLINE", F.lit(False))
    none = F.lit(None).cast("string")

    def entry(bucket: str, shown: Column, stamp: Column, offset: Column) -> Column:
        values = (today, F.lit(bucket), shown.cast("date"), none, none, stamp, offset.cast("int"))
        return F.struct(*[v.alias(name) for v, name in zip(values, _SHOWN)])

    def entries_of(df: DataFrame, *found: Column) -> DataFrame:
        """One row for each entry that is not null."""
        return df.select(*_TASK, F.inline(F.filter(F.array(*found), lambda e: e.isNotNull())))

    ahead, left = F.datediff("base", today), F.datediff("first_standing", today)
    warned = F.coalesce("warning_days", F.lit(WARNING_DAYS))
    single = entries_of(
        series.where("rep is null"),
        F.when((F.col("base") < today) & _lasting(), entry("overdue", F.col("base"), F.col("timestamp"), ahead)),
        F.when(deadline & (ahead > 0) & (ahead <= warned), entry("upcoming", F.col("base"), F.col("timestamp"), ahead)),
    )
    text = cell_stamp(F.col("timestamp_type"), F.col("owed_date"), none, F.col("timestamp_repeater"))
    repeated = entries_of(
        _ends(series.where(F.col("rep").isNotNull() & _lasting()), current, work),
        F.when((F.col("owed_date") < today) & ((F.col("unit") != "wd") | F.lit(work.works_on(current))), entry("overdue", F.col("owed_date"), text, F.datediff("owed_date", today))),
        F.when(deadline & (today < F.col("base")) & (left > 0) & (left <= warned), entry("upcoming", F.col("base"), F.col("timestamp"), left)),
    )
    return single.unionByName(repeated)


def entries(tasks: DataFrame, calendar: Workdays | DataFrame, first: date, last: date, current: date) -> DataFrame:
    """The rows of ``agenda`` without their rank: nothing is shuffled or written for them."""
    series, work = series_of(tasks), Workdays.of(calendar)
    cells = _cells(series, first, last, work)
    return cells.unionByName(_due(series, current, work)) if first <= current <= last else cells


def agenda(tasks: DataFrame, calendar: Workdays | DataFrame, first: date, last: date, current: date) -> DataFrame:
    """``(day, bucket, rank, days_offset, ...)`` for the days from ``first`` to ``last``.

    ``tasks`` have ``excluded_dates`` and ``replaced_dates`` (see ``exceptions.with_replaced``) and should be a written
    table. Occurrences lie inside the window; overdue and upcoming entries on the current date alone. An end time is that
    of a stamp without a repeater, drawn on its own day. The order of a day's scheduled entries is one of their tasks, so
    tasks are dealt by its ranges and drawn where they lie then: a task moves once, however many days it is drawn on.
    """
    series, work = series_of(tasks), Workdays.of(calendar)
    name = [F.col("root"), F.col("file"), F.col("line")]
    by = F.when(F.col("timestamp_time").isNull(), F.col("priority_order")).asc_nulls_first()
    needed = [*_TASK, "priority_order", "timestamp", "timestamp_time", "timestamp_end_time", "timestamp_repeater", "rep", "base", "n", "unit", "excluded_dates", "replaced_dates"]
    dealt = series.select(*needed).repartitionByRange(_timed(), by, F.col("timestamp_time").asc_nulls_first(), *name)
    cells = _cells(dealt, first, last, work, "priority_order")
    shown = F.when(F.col("bucket") == "scheduled_no_time", F.col("priority_order")).asc_nulls_first()
    cells = cells.sortWithinPartitions("day", "bucket", shown, F.col("time").asc_nulls_first(), *name)
    out = numbered(cells.drop("priority_order"), ["day", "bucket"])
    if not first <= current <= last:
        return out
    return out.unionByName(ranked(as_table(_due(series, current, work)), ["day", "bucket"], [F.col("days_offset"), *name]))


def day_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("day", "bucket").agg(F.count("*").alias("entries"))


def envelopes(found: DataFrame, first: date, last: date) -> DataFrame:
    """One nested row a day, days without entries too; ``overdue`` is null where it is empty, so a JSON sink omits it. A row
    holds its whole day; for days of any size see ``envelope_parts``."""
    entry = F.struct(*_ENTRY)
    lists = found.groupBy("day").agg(*[F.array_sort(F.collect_list(F.when(F.col("bucket") == b, entry))).alias(b) for b in BUCKETS])
    days = found.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date"))).alias("day"))
    out = days.join(lists, "day", "left")
    empty = lambda b: F.coalesce(b, F.slice(b, 1, 0), F.from_json(F.lit("[]"), lists.schema[b].dataType))
    return out.select("day", F.when(F.size("overdue") > 0, F.col("overdue")).alias("overdue"), *[empty(b).alias(b) for b in BUCKETS[1:]])


def envelope_sizes(found: DataFrame, first: date, last: date) -> DataFrame:
    """``(day, overdue, scheduled_timed, ...)``: the number of entries in each list of the envelopes; no list is made."""
    sizes = found.groupBy("day").agg(*[F.count_if(F.col("bucket") == b).cast("int").alias(b) for b in BUCKETS])
    days = found.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date"))).alias("day"))
    return days.join(sizes, "day", "left").select("day", *[F.coalesce(b, F.lit(0)).alias(b) for b in BUCKETS])


_ENTRY = ["rank", "file", "line", "heading", "task_type", "priority", "timestamp_type", "date", "time", "end_time", "stamp", "days_offset"]


def envelope_parts(found: DataFrame, first: date, last: date, size: int = 1000) -> DataFrame:
    """``(day, place, part, text)``: the envelopes as pieces of JSON text, ``size`` entries each at most.

    Pieces in the order of (day, place, part), one after another, are the days' objects; white space may stand between
    them. A day of any number of entries is many rows, none of which holds more than its piece.
    """
    spark = found.sparkSession
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")).cast("int")
    entry = F.struct(F.col("rank"), F.to_json(F.struct(*_ENTRY)).alias("json"))
    parts = found.groupBy("day", place.alias("place"), ((F.col("rank") - 1) / size).cast("long").alias("part"))
    parts = parts.agg(F.array_join(F.array_sort(F.collect_list(entry))["json"], ",").alias("text"), F.max("rank").alias("upto"))
    sizes = found.groupBy("day", place.alias("place")).agg(F.count("*").alias("entries"))  # a row for each day and bucket
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date"))).alias("day"))
    name = F.element_at(F.array(*map(F.lit, BUCKETS)), F.col("place"))
    opened = F.when(F.col("part") == 0, F.concat(F.lit(',"'), name, F.lit('":['))).otherwise(",")
    body = parts.join(sizes, ["day", "place"]).select("day", "place", "part", F.concat(opened, "text", F.when(F.col("upto") == F.col("entries"), "]").otherwise("")).alias("text"))
    empty = days.select("day", F.explode(F.array(*[F.lit(k + 1) for k in range(1, len(BUCKETS))])).alias("place")).join(sizes, ["day", "place"], "left_anti")
    empty = empty.select("day", "place", F.lit(0).cast("long").alias("part"), F.concat(F.lit(',"'), name, F.lit('":[]')).alias("text"))
    edge = lambda k, text: days.select("day", F.lit(k).alias("place"), F.lit(0).cast("long").alias("part"), text.alias("text"))
    return body.unionByName(empty).unionByName(edge(0, F.concat(F.lit('{"day":"'), F.col("day").cast("string"), F.lit('"')))).unionByName(edge(len(BUCKETS) + 1, F.lit("}")))


def next_occurrences(series: DataFrame, current: date, now: str = "00:00", calendar: Workdays | DataFrame | None = None) -> DataFrame:
    """``series(base, n, unit, timestamp_time, excluded_dates, replaced_dates)`` with ``next_date`` from now (today counts
    until its time has passed) and ``next_after`` the current day. Series on working days have neither without a calendar."""
    work = None if calendar is None else Workdays.of(calendar)
    today = f"date'{current.isoformat()}'"
    slot = F.when(F.col("timestamp_time").rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9]$"), F.lpad("timestamp_time", 5, "0"))
    # one date more than may be missing: the one of today may have passed
    ahead = rec.standing(rec.candidates("base", "n", "unit", today, f"{_MISSING} + 1", ahead=True, work=work), F.col("excluded_dates"), F.col("replaced_dates"))
    out = series.withColumn("_ahead", ahead).withColumn("_here", F.array_min("_ahead"))
    out = out.withColumn("next_after", F.when(F.col("_here") > F.expr(today), F.col("_here")).otherwise(F.array_min(F.filter("_ahead", lambda d: d > F.expr(today)))))
    passed = F.coalesce((F.col("_here") == F.expr(today)) & (slot < now), F.lit(False))
    return out.withColumn("next_date", F.when(passed, F.col("next_after")).otherwise(F.col("_here"))).drop("_ahead", "_here")


def arrears(series: DataFrame, current: date, calendar: Workdays | DataFrame) -> DataFrame:
    """``series(base, n, unit, excluded_dates, replaced_dates)`` with ``owed_date`` at the current date."""
    return _ends(series, current, Workdays.of(calendar)).drop("first_standing")


def with_next(found: DataFrame, tasks: DataFrame, calendar: Workdays | DataFrame, current: date, now: str = "00:00") -> DataFrame:
    """The drawn cells of series in ``found`` (an agenda's rows) with ``timestamp_next``, the next occurrence from now, and
    ``timestamp_next_after``, the one after the cell's day. Overdue and upcoming entries and single stamps have neither
    and are left out."""
    key, work = ["root", "file", "line"], Workdays.of(calendar)
    series = series_of(tasks).where("rep is not null").select(*key, "base", "n", "unit", "timestamp_time", "excluded_dates", "replaced_dates")
    series = next_occurrences(series, current, now, work)
    cells = found.where(F.col("bucket").startswith("scheduled")).alias("f")
    same = F.col("f.root").eqNullSafe(F.col("s.root")) & (F.col("f.file") == F.col("s.file")) & (F.col("f.line") == F.col("s.line"))
    cells = cells.join(series.alias("s"), same).select("f.*", "s.base", "s.n", "s.unit", "s.excluded_dates", "s.replaced_dates", F.col("s.next_date").alias("timestamp_next"))
    after = rec.candidates("base", "n", "unit", "date_add(day, 1)", _MISSING, ahead=True, work=work)
    cells = cells.withColumn("timestamp_next_after", rec.next_standing(after, F.col("excluded_dates"), F.col("replaced_dates")))
    return cells.drop("base", "n", "unit", "excluded_dates", "replaced_dates")


def cells_with_next(tasks: DataFrame, calendar: Workdays | DataFrame, first: date, last: date, current: date, now: str = "00:00") -> DataFrame:
    """``with_next`` of an agenda's rows, from the tasks themselves: a series finds its next dates where it is drawn, so
    nothing is joined."""
    work = Workdays.of(calendar)
    series = next_occurrences(series_of(tasks).where("rep is not null"), current, now, work)
    more = ["base", "n", "unit", "excluded_dates", "replaced_dates"]
    cells = _cells(series, first, last, work, *more, "next_date")
    after = rec.candidates("base", "n", "unit", "date_add(day, 1)", _MISSING, ahead=True, work=work)
    cells = cells.withColumn("timestamp_next_after", rec.next_standing(after, F.col("excluded_dates"), F.col("replaced_dates")))
    return cells.withColumnRenamed("next_date", "timestamp_next").drop(*more)
