"""Where the parts of headings and stamps stand, as byte offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesperline.functions import stamps
from vesperline.operators.blocks import heading_lines
from vesperline.operators.extract import MARK, STATE, computed

_LINE = r"^ {0,3}(#{1,6})[ \t]+"


def _bytes_before(text: Column, chars: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), chars)).cast("int")


def _span(text: Column, begin: Column, token: Column) -> Column:
    """(start, end) in bytes of a token that begins after ``begin`` characters; null for an empty token."""
    start = _bytes_before(text, begin)
    return F.when(token != "", F.struct(start.alias("start"), (start + F.octet_length(token)).cast("int").alias("end"), token.alias("text")))


def heading_spans(notes: DataFrame) -> DataFrame:
    """``(root, file, line, level, state, mark, title)`` of every heading line; the parts are spans with their text."""
    rows = heading_lines(notes).where(F.col("written").rlike(_LINE))
    kept, t = ["root", "file", "line"], F.col("written")
    # what several parts need is computed once, step by step
    rows = computed(rows, [*kept, "written"], lead=F.length(F.regexp_substr(t, F.lit(_LINE))))
    rows = rows.withColumn("rest", F.substring(t, F.col("lead") + 1, F.length(t)))
    rows = computed(rows, [*kept, "written", "lead", "rest"], opened=F.coalesce(F.regexp_substr("rest", F.lit(STATE)), F.lit("")))
    gap = F.length("opened")
    rows = computed(rows, [*kept, "written", "lead", "opened"], gap=gap, after=F.substring("rest", gap + 1, F.length("rest")))
    marked = F.col("after").contains("[#")
    mark = F.when(marked, F.coalesce(F.regexp_substr("after", F.lit(MARK)), F.lit(""))).otherwise("")
    rows = computed(rows, [*kept, "written", "lead", "opened", "gap", "after"], mark=mark)
    lead, gap, after, mark = (F.col(c) for c in ("lead", "gap", "after", "mark"))
    place = F.instr(after, mark) - 1
    spaced = F.substring(after, F.length(mark) + 1, F.lit(1)) == " "
    skip = F.when((mark != "") & (place == 0), F.length(mark) + spaced.cast("int")).otherwise(0)
    rows = computed(rows, [*kept, "written", "lead", "gap", "mark"], place=place, skip=skip, state=F.regexp_extract("opened", STATE, 1), title=F.regexp_replace(F.substring(after, skip + 1, F.length(after)), r"[ \t]+$", ""))
    place, skip = F.col("place"), F.col("skip")
    return rows.select(
        *kept, F.length(F.regexp_extract(t, _LINE, 1)).alias("level"), _span(t, lead, F.col("state")).alias("state"),
        _span(t, lead + gap + place, mark).alias("mark"), _span(t, lead + gap + skip, F.col("title")).alias("title"),
    )


def stamp_spans(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``texts`` with spans of the first stamp: whole, date and weekday as written; its repeater and whether it is active.
    A stamp whose date does not exist is none."""
    t = F.col(text_col)
    whole = F.coalesce(F.regexp_substr(t, F.lit(r"<[0-9]{4}-[0-9]{2}-[0-9]{2}[^<>]{0,256}>|\[[0-9]{4}-[0-9]{2}-[0-9]{2}[^\[\]]{0,256}\]")), F.lit(""))
    found = computed(texts, texts.columns, _whole=whole).where("_whole <> ''")
    whole, at = F.col("_whole"), F.instr(t, F.col("_whole")) - 1
    found = computed(found, found.columns, _at=at, _date=F.substring(whole, 2, 10), _day=F.regexp_extract(whole, r"^.[0-9-]{10} (\p{L}+)", 1), _rep=stamps.repeater(whole))
    return found.where(stamps.real_date(F.col("_date")).isNotNull()).select(
        *texts.columns, _span(t, F.col("_at"), whole).alias("stamp"), _span(t, F.col("_at") + 1, F.col("_date")).alias("date"), _span(t, F.col("_at") + 12, F.col("_day")).alias("weekday"),
        stamps.repeater_text(F.col("_rep")).alias("repeater"), whole.startswith("<").alias("active"),
    )
