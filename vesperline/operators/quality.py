"""Data-quality findings of a run as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperline.functions.text import trimmed
from vesperline.operators.exceptions import recurrence, rejected_fields
from vesperline.operators.extract import KEY, computed

SHOWN = 20
FINDINGS = "array<struct<line:int,channel:string,key:string,value:string,problem:string>>"
_COLUMNS = ["root", "file", "line", "channel", "key", "value", "problem"]


def findings(sections: DataFrame) -> DataFrame:
    """``(root, file, line, channel, key, value, problem)`` for sections that are tasks.

    Channels: 'timestamp' for stamps whose date does not exist, 'property' for the rest.
    """
    rows = sections.where("task_type is not null or created is not null or timestamp is not null")
    get = lambda k: F.try_element_at("properties", F.lit(k))
    # one pass over the tasks: what each one sends on is a list
    rows = computed(
        rows, [*KEY, "line", "timestamp", "timestamp_type", "base_date", "property_blocks", "excluded_dates", "series_id", "recurrence_id"],
        exdate=get("EXDATE"), rejected=rejected_fields(get("EXDATE")), written_id=get("RECURRENCE_ID"), r=recurrence(get("RECURRENCE_ID")), wrote_series=get("SERIES_ID").isNotNull(),
    )

    def finding(name: str, key, value, problem: str, line=None) -> Column:
        return F.struct((F.col("line") if line is None else line).cast("int").alias("line"), F.lit(name).alias("channel"), key.cast("string").alias("key"), value.alias("value"), F.lit(problem).alias("problem"))

    def of_line(x: Column) -> Column:
        return finding("property", F.lit(None), x["text"], "not a key and a value", x["line"])

    line = F.flatten(F.transform("property_blocks", lambda b: F.transform(F.split(b["body"], "\n"), lambda t, i: F.struct((b["at"] + 1 + i).alias("line"), t.alias("text")))))
    keyless = lambda t: ~t.contains(":") | (trimmed(F.substring_index(t, ":", 1)) == "")
    bad_lines = F.transform(F.filter(line, lambda x: keyless(x["text"]) & (trimmed(x["text"]) != "")), of_line)
    bad_fields = F.transform("rejected", lambda f: finding("property", F.lit("EXDATE"), f, "not a date"))
    half_key = F.when(F.col("series_id").isNull() & F.col("recurrence_id").isNotNull(), "RECURRENCE_ID").otherwise("SERIES_ID")
    named = F.col("written_id").isNotNull()
    single = [
        F.when(F.col("timestamp").isNotNull() & F.col("base_date").isNull(), finding("timestamp", F.col("timestamp_type"), F.col("timestamp"), "not a calendar date")),
        F.when((F.size("rejected") == 0) & F.col("excluded_dates").isNull(), finding("property", F.lit("EXDATE"), F.col("exdate"), "no date to cancel")),
        F.when(named & F.col("r").isNull(), finding("property", F.lit("RECURRENCE_ID"), F.col("written_id"), "not a date")),
        F.when(F.col("r.dropped").isNotNull(), finding("property", F.lit("RECURRENCE_ID"), F.col("r.dropped"), "not a time")),
        F.when((F.col("wrote_series") | named) & (F.col("series_id").isNull() | F.col("recurrence_id").isNull()), finding("property", half_key, F.coalesce("series_id", "recurrence_id", F.lit("")), "half a pair")),
    ]
    found = [F.coalesce(x, F.array().cast(FINDINGS)) for x in (bad_lines.cast(FINDINGS), bad_fields.cast(FINDINGS))]
    return rows.select(*KEY, F.inline(F.concat(*found, F.filter(F.array(*single).cast(FINDINGS), lambda x: x.isNotNull())))).select(_COLUMNS)


CHANNELS = ("timestamp", "property")


def first_findings(found: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first ``n`` findings of each channel, by tasks and then among what each task sends on; only those few get
    their position."""
    order = ["root", "file", "line", "key", "value", "problem"]
    few = None
    for channel in CHANNELS:
        first = found.where(F.col("channel") == channel).orderBy(*order).limit(n)
        few = first if few is None else few.unionByName(first)
    return few.withColumn("position", F.row_number().over(Window.partitionBy("channel").orderBy(*order)))
