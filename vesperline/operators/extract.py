"""Notes to tasks: headings, stamps, clocks and properties of sections as column expressions.

Sections come from ``operators.blocks`` where each note lies, so a corpus is never shuffled by its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vesperline.functions import stamps
from vesperline.functions.text import trimmed
from vesperline.operators.blocks import fields, sections
from vesperline.operators.ranking import ranked
from vesperline.sources.scratch import as_table

#: Clock bodies, hours of a clock, tasks of a run.
CLOCK_BODY, MAX_HOURS, MAX_TASKS = 128, 10_000, 10_000
KEY = ["root", "file"]

#: States that open a heading, and its priority mark.
STATE = r"(?U)^(TODO|DONE|CANCELLED|CANCELED)\s+"
MARK = r"\[#([A-Z]|6[0-4]|[1-5][0-9]|[0-9])\]"


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, here: later filters and uses read their values."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def marked_title(rest: Column) -> tuple[Column, Column]:
    """(priority, display text) of a title behind its state. The mark goes from the text only where it opens it."""
    marked = rest.contains("[#")
    priority = F.when(marked, F.nullif(F.regexp_extract(rest, MARK, 1), F.lit("")))
    return priority, F.when(marked, F.regexp_replace(rest, "^" + MARK + " ?", "")).otherwise(rest)


def clock_entries(text: Column) -> Column:
    """``array<struct<start, end, duration>>`` of all entries, in order."""
    body = rf"[^\]<>]{{1,{CLOCK_BODY}}}"
    stamp = rf"(?:\[{body}\]|<{body}>)"
    # the groups are a first stamp's body, a second one's and a duration; a pass over the text for each, none for an entry
    inner = rf"[\[<]((?<=\[){body}(?=\])|(?<=<){body}(?=>))[\]>]"
    entry = lambda first, second, spent: rf"CLOCK:\s*{first}(?:--{second})?(?:\s*=>\s*{spent})?"
    hours = "[0-9]{1,5}:[0-9]{1,2}"
    of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    found = F.arrays_zip(of(entry(inner, stamp, hours)).alias("start"), of(entry(stamp, inner, hours)).alias("end"), of(entry(stamp, stamp, f"({hours})")).alias("duration"))
    return F.transform(found, lambda c: F.struct(*[F.nullif(c[n], F.lit("")).alias(n) for n in ("start", "end", "duration")]))


def minutes(duration: Column) -> Column:
    """``H:MM`` in minutes; null where hours are over the bound or minutes are 60 and more."""
    hours, rest = (F.substring_index(duration, ":", k).try_cast("bigint") for k in (1, -1))
    return F.when(duration.rlike(r"^([0-9]{1,5}):([0-9]{1,2})$") & (hours <= MAX_HOURS) & (rest < 60), hours * 60 + rest)


def duration_text(total: Column) -> Column:
    return F.when(total.isNotNull(), F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0")))


def clock_total(clocks: Column) -> Column:
    """The sum of readable durations; null where there is none or the sum leaves 32 bits."""
    spent = F.filter(F.transform(clocks, lambda c: minutes(c["duration"])), lambda m: m.isNotNull())
    total = F.aggregate(spent, F.lit(None).cast("bigint"), lambda a, m: F.coalesce(a, F.lit(0).cast("bigint")) + m)
    return _bound(total, lambda t: F.when(t <= 4294967295, t))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def property_map(block_texts: Column) -> Column:
    """Key to value over all property blocks: split at the first colon, trimmed; the last of equal keys wins."""

    def mapped(pairs: Column) -> Column:
        keys = F.sort_array(F.array_distinct(F.transform(pairs, lambda p: p["key"])))
        last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
        return F.when(F.size(pairs) > 0, _bound(keys, lambda ks: F.map_from_arrays(ks, F.transform(ks, last))))

    # one step after the other: what a step makes is computed once
    lines = F.filter(F.flatten(F.transform(block_texts, lambda t: F.split(t, "\n"))), lambda x: x.contains(":"))
    cut = F.transform(lines, lambda x: F.struct(x.alias("line"), F.substring_index(x, ":", 1).alias("key")))
    cut = F.transform(cut, lambda p: F.struct(p["key"].alias("key"), p["line"].substr(F.length(p["key"]) + 2, F.length(p["line"])).alias("value")))
    pairs = F.transform(cut, lambda p: F.struct(trimmed(p["key"]).alias("key"), trimmed(p["value"]).alias("value")))
    return _bound(F.filter(pairs, lambda p: p["key"] != ""), mapped)


#: What sections hold besides their heading and stamps; a query that needs less does not pay for it.
PARTS = ("content", "clocks", "properties")


def _from_blocks(found: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """The texts of sections that may hold stamps or clocks, by block, and their paragraphs and property blocks."""

    def texts(b: Column) -> Column:
        bare = F.when(b["kind"] == "indented", F.regexp_replace(b["body"], r"(?m)^(?: {4}| {0,3}\t)", "")).otherwise(b["body"])
        literal = F.transform(F.transform(F.array(bare), trimmed), lambda t: F.when(t.startswith("`"), F.regexp_replace(t, r"(?s)^(`+)(.+?)\1$", "$2")).otherwise(t))
        return F.when(b["kind"] == "text", b["codes"]).otherwise(literal)

    is_properties = lambda b: F.coalesce(b["info"] == "org-properties", F.lit(False))
    read = {
        "written": F.transform(F.filter("blocks", lambda b: ~is_properties(b)), texts),
        "paragraphs": F.transform(F.filter("blocks", lambda b: b["kind"] == "text"), lambda b: trimmed(b["body"])),
    }
    if "properties" in parts:
        read["property_blocks"] = F.transform(F.filter("blocks", is_properties), lambda b: F.struct(b["at"].alias("at"), b["body"].alias("body")))
    out = computed(found, [*KEY, "line", "level", "title"], **read)
    stamped = F.transform("written", lambda ts: F.filter(ts, stamps.may_open_with_stamp))
    return out.withColumn("texts", F.transform(stamped, lambda ts: F.transform(ts, stamps.english_weekdays)))


def parsed_sections(notes: DataFrame, cap: int = 0, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Sections with the fields of their headings and blocks; not every one is a task. ``parts`` names the groups of
    columns to make: ``content``, ``clocks`` with their totals, ``properties`` with their blocks, ``pairs`` for properties
    alone. Without content the pass that reads a note finds stamps and properties too, and no block leaves it."""
    whole = "content" in parts
    out = (_from_blocks(sections(notes, cap, parts), parts) if whole else fields(notes, cap, parts)).withColumnRenamed("title", "shown")
    out = out.withColumn("_state", F.regexp_extract("shown", STATE, 1)).withColumn("_rest", F.when(F.col("_state") != "", F.regexp_replace("shown", STATE, "")).otherwise(F.col("shown")))
    state, priority, heading = F.nullif(F.col("_state"), F.lit("")), *marked_title(F.col("_rest"))
    made = {"heading": trimmed(heading), "task_type": state, "priority": priority}
    kept = [*KEY, "line", "level", *["property_blocks"] * ("properties" in parts)]
    if whole:
        texts = lambda read: F.transform("texts", lambda t: F.get(F.filter(read(t), lambda v: v.isNotNull()), F.lit(0)))
        last = lambda values: F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(-1))
        made |= {"created": last(texts(stamps.created_stamps)), "timestamp": last(texts(stamps.planning_stamps)), "content": F.array_join(F.filter("paragraphs", lambda p: p != ""), "\n\n")}
        if "properties" in parts:
            made["properties"] = property_map(F.transform("property_blocks", lambda b: b["body"]))
    else:
        kept += ["created", "timestamp", *["properties"] * ("properties" in parts or "pairs" in parts)]
    if "clocks" in parts:
        clocked = F.filter(F.flatten("written"), lambda t: t.contains("CLOCK:")) if whole else F.col("clock_texts")
        made["found_clocks"] = F.flatten(F.transform(clocked, clock_entries))
    out = computed(out, kept, **made)
    if "clocks" in parts:
        out = out.withColumn("clocks", F.when(F.size("found_clocks") > 0, F.col("found_clocks"))).drop("found_clocks")
        out = out.withColumn("clock_minutes", clock_total(F.col("clocks"))).withColumn("total_clock_time", duration_text(F.col("clock_minutes")))
    # what several fields are made of is computed once, step by step
    stamp = F.col("timestamp")
    out = out.withColumns({"timestamp_date": stamps.stamp_date(stamp), "_token": stamps.repeater_token(stamp), **stamps.time_parts(stamp)})
    out = out.withColumns({"base_date": stamps.real_date(F.col("timestamp_date")), "_number": stamps.repeater_number(F.col("_token")), "_pair": stamps.time_pair(F.col("_first"))})
    start, end = stamps.times_of(F.col("_pair"), F.col("_first"), F.col("_second"))
    out = out.withColumns({
        "priority_order": stamps.priority_order(F.col("priority")), "timestamp_type": stamps.stamp_type(stamp), "timestamp_active": stamps.is_active(stamp),
        "timestamp_time": start, "timestamp_end_time": end, "rep": stamps.repeater_of(F.col("_token"), F.col("_number"), F.col("base_date")), "warning_days": stamps.warning_days(stamp),
    })
    return out.drop("_token", "_first", "_second", "_number", "_pair").withColumn("timestamp_repeater", stamps.repeater_text(F.col("rep")))


def tasks(notes: DataFrame, cap: int = 0, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Sections with a state, a creation stamp or a planning stamp, and their exception fields where properties are
    read. With a cap no note is read past its first ``cap`` sections that have a state."""
    from vesperline.operators.exceptions import with_exceptions

    kept = parsed_sections(notes, cap, parts).where("task_type is not null or created is not null or timestamp is not null")
    return with_exceptions(kept) if "properties" in parts or "pairs" in parts else kept


def capped(found: DataFrame, cap: int = MAX_TASKS) -> DataFrame:
    """The first ``cap`` tasks of a run, by root, file and line: counted in ranges, so no task gathers them.

    A task that ``cap`` others of its partition precede is not among the first of all. So each partition is sorted where
    it lies and writes its first ``cap`` alone: the notes are read once, and not again to find the ranges."""
    if not 1 <= cap <= 10_000_000:
        raise ValueError("the cap is between 1 and 10,000,000")
    order = [F.col(c) for c in (*KEY, "line")]
    numbered = found.sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return ranked(as_table(numbered.where(F.col("_n") < cap).drop("_n")), [], order, "_n").where(F.col("_n") <= cap).drop("_n")


def capped_notes(found: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` tasks of each note, by line. A note has passed the gate of size, so its tasks fit one group."""
    at = F.row_number().over(Window.partitionBy(*KEY).orderBy("line"))
    return found.withColumn("_n", at).where(F.col("_n") <= cap).drop("_n")
