"""The working-day calendar: listed holidays and workdays, and a day-by-day dimension with a running count."""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_YEARS = "map<string, struct<holidays: array<string>, workdays: array<string>>>"


def listed_days(spark: SparkSession, json_text: str | None = None) -> DataFrame:
    """``(d, workday)`` for every listed date; keys that begin with ``_`` are skipped and an impossible date fails.

    The packaged list is a few kilobytes and travels inside the plan, so executors need no file.
    """
    text = json_text or files("vesperline.sources").joinpath("holidays.json").read_text("utf-8")
    years = spark.range(1).select(F.explode(F.from_json(F.lit(text), _YEARS)).alias("year", "lists")).where("year not like r'\\_%'")
    both = F.array(
        F.struct(F.lit(False).alias("workday"), F.col("lists.holidays").alias("days")),
        F.struct(F.lit(True).alias("workday"), F.col("lists.workdays").alias("days")),
    )
    flat = years.select("year", F.inline(both)).select("year", "workday", F.explode("days").alias("text"))
    checked = F.when(F.col("text").startswith(F.concat("year", F.lit("-"))), F.col("text")).otherwise(
        F.raise_error(F.concat(F.lit("a date outside its year: "), F.col("text")))
    )
    return flat.select(checked.cast("date").alias("d"), "workday")


def calendar(spark: SparkSession, first: str, last: str, json_text: str | None = None) -> DataFrame:
    """``(d, is_workday, wd_ord)`` for each day from ``first`` to ``last``; a listed workday wins over a listed holiday.

    ``wd_ord`` counts workdays up to and including the day. The dimension has one row a day (73,000 for two
    centuries), whatever the task table's size; it is what the working-day operators join to.
    """
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("d"))
    listed = listed_days(spark, json_text).groupBy("d").agg(F.max("workday").alias("workday"))
    is_workday = F.coalesce(F.col("workday"), F.weekday("d") < 5)
    # one partition a year counts within it; the years' totals are then added up over a handful of rows
    days = days.join(F.broadcast(listed), "d", "left").select("d", is_workday.alias("is_workday"), F.year("d").alias("y"))
    within = F.sum(F.col("is_workday").cast("long")).over(Window.partitionBy("y").orderBy("d"))
    totals = days.groupBy("y").agg(F.sum(F.col("is_workday").cast("long")).alias("n"))
    earlier = totals.select("y", F.coalesce(F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return days.withColumn("within", within).join(F.broadcast(earlier), "y").select("d", "is_workday", (F.col("before") + F.col("within")).alias("wd_ord"))


def holidays_of_year(spark: SparkSession, year: int, json_text: str | None = None) -> DataFrame:
    return listed_days(spark, json_text).where((F.year("d") == year) & ~F.col("workday")).select("d")
