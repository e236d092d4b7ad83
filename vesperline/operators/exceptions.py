"""Exceptions to a series: cancelled dates, replacements, and who replaces what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperline.functions.text import trimmed
from vesperline.sources.scratch import as_table

_CLOCK = r"^(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9](?::[0-5]?[0-9])?$"
_DATE = r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"


def _date(field: Column) -> Column:
    return F.when(field.rlike(_DATE), field.try_cast("date"))


def _fields(raw: Column) -> Column:
    return F.filter(F.split(raw, "[, \t]"), lambda f: f != "")


def excluded_dates(raw: Column) -> Column:
    """Dates of an EXDATE value in order, each once."""
    return F.array_distinct(F.filter(F.transform(_fields(raw), _date), lambda d: d.isNotNull()))


def rejected_fields(raw: Column) -> Column:
    """Fields that are neither a date nor the time of the date right before."""
    fields = _fields(raw)
    after = F.concat(F.array(F.lit("")), fields)
    marked = F.transform(fields, lambda f, i: F.struct(f.alias("f"), (_date(f).isNotNull() | (f.rlike(_CLOCK) & _date(F.get(after, i)).isNotNull())).alias("ok")))
    return F.transform(F.filter(marked, lambda x: ~x["ok"]), lambda x: x["f"])


def recurrence(raw: Column) -> Column:
    """``struct(date, value, dropped)``: the occurrence a RECURRENCE_ID names, and the text left over; null if unreadable."""
    fields = F.filter(F.split(raw, r"(?U)\s+"), lambda f: f != "")
    date = _date(F.get(fields, F.lit(0)))
    clock = F.get(fields, F.lit(1))
    timed = F.coalesce(clock.rlike(_CLOCK), F.lit(False))
    parts = F.split(clock, ":")
    text = F.when(timed, F.concat(F.lit(" "), F.lpad(parts[0], 2, "0"), F.lit(":"), F.lpad(parts[1], 2, "0"))).otherwise("")
    rest = F.array_join(F.slice(fields, F.when(timed, 3).otherwise(2), F.greatest(F.size(fields), F.lit(1))), " ")
    return F.when(date.isNotNull(), F.struct(date.alias("date"), F.concat(date.cast("string"), text).alias("value"), F.nullif(rest, F.lit("")).alias("dropped")))


def with_exceptions(tasks: DataFrame) -> DataFrame:
    """Tasks with ``excluded_dates``, ``recurrence_id``, ``recurrence_date`` and ``series_id`` from their properties."""
    get = lambda k: F.try_element_at("properties", F.lit(k))
    dates, occurrence = excluded_dates(get("EXDATE")), recurrence(get("RECURRENCE_ID"))
    return tasks.withColumns({
        "excluded_dates": F.when(F.size(dates) > 0, dates), "recurrence_id": occurrence["value"], "recurrence_date": occurrence["date"],
        "series_id": F.nullif(trimmed(get("SERIES_ID")), F.lit("")),
    })


def replacements(tasks: DataFrame) -> DataFrame:
    """``(series_id, replaced_dates)``: the occurrences that other entries stand in for, gathered before any join."""
    both = tasks.where("series_id is not null and recurrence_date is not null")
    return both.groupBy("series_id").agg(F.array_sort(F.collect_set("recurrence_date")).alias("replaced_dates"))


_BROADCAST = 8 << 20


def with_replaced(tasks: DataFrame) -> DataFrame:
    """Tasks with ``series_key`` (their own ID, of their properties where they have no such column) and
    ``replaced_dates``; every row with an ID gets its series' set.

    ``tasks`` is read twice and should be a written table. The sets are written, and sent to all tasks only where they
    are a few megabytes; beyond, rows with an ID are shuffled to them, and rows without one stay where they are.
    """
    keyed = tasks if "series_key" in tasks.columns else tasks.withColumn("series_key", F.try_element_at("properties", F.lit("ID")))
    found = as_table(replacements(tasks).withColumnRenamed("series_id", "series_key"))
    size = found.agg(F.sum(64 + F.length("series_key") + 4 * F.size("replaced_dates"))).first()[0] or 0
    if size <= _BROADCAST:
        joined = keyed.join(F.broadcast(found), "series_key", "left")
    else:
        alone = keyed.where("series_key is null").withColumn("replaced_dates", F.lit(None).cast("array<date>"))
        joined = keyed.where("series_key is not null").join(found, "series_key", "left").unionByName(alone)
    empty = F.array().cast("array<date>")
    return joined.withColumns({"replaced_dates": F.coalesce("replaced_dates", empty), "excluded_dates": F.coalesce("excluded_dates", empty)}).withColumn(
        "missing_dates", F.array_union("excluded_dates", "replaced_dates")
    )


def unknown_series(tasks: DataFrame) -> DataFrame:
    """Series ids that no entry has as its ID."""
    known = tasks.select(F.try_element_at("properties", F.lit("ID")).alias("series_id")).where("series_id is not null").distinct()
    return replacements(tasks).select("series_id").join(known, "series_id", "left_anti")
