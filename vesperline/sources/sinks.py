"""JSON sinks. Absent fields are omitted, which is Spark's own way with nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = [
    "file", "root", "line", "heading", "content", "task_type", "priority", "created", "timestamp", "timestamp_type", "timestamp_active", "timestamp_date",
    "timestamp_time", "timestamp_end_time", "timestamp_repeater", "clocks", "total_clock_time", "properties", "excluded_dates", "recurrence_id", "series_id",
]


def task_json(tasks: DataFrame) -> DataFrame:
    return tasks.select("root", "file", "line", F.to_json(F.struct(*FIELDS)).alias("json"))


def write_tasks(tasks: DataFrame, path: str) -> None:
    tasks.select(FIELDS).write.json(path, ignoreNullFields=True)


def write_days(envelopes: DataFrame, path: str) -> None:
    envelopes.write.json(path, ignoreNullFields=True)


def write_day_parts(parts: DataFrame, path: str) -> None:
    """Pieces of envelopes (``agenda.envelope_parts``) as text files: in the order of their names they are one run of JSON
    objects, a day each. Days are dealt by ranges, so one that is large lies in several files, each written by its task."""
    order = ["day", "place", "part"]
    parts.repartitionByRange(*order).sortWithinPartitions(*order).select("text").write.text(path)
