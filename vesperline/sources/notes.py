"""Note files as a table, the gates before parsing, and the run report."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vesperline.sources.scratch import as_table

#: The largest note read, and what a note must hold to be parsed.
MAX_FILE_SIZE = 10 * 1024 * 1024
MARKERS = r"(?m)(^[#*]+\s+(TODO|DONE)\s|DEADLINE:|SCHEDULED:|CREATED:|CLOSED:|CLOCK:)"
SHOWN_PATHS = 20


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\ufeff", "")


def glob_to_regex(pattern: str) -> str:
    """A glob as a regular expression for ``rlike``: ``*``, ``?``, ``**``, classes and alternatives. An empty pattern, a
    bare ``*.`` and one with an open or stray bracket are refused."""
    if not pattern or pattern == "*.":
        raise ValueError(f"not a usable glob: {pattern!r}")
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            negated = pattern[i + 1 : i + 2] in ("!", "^")
            begin = i + 1 + negated
            end = pattern.find("]", begin + 1)  # a bracket that comes first is one of the class
            if end < 0:
                raise ValueError(f"an open class in {pattern!r}")
            inside = "".join("\\" + x if x in "\\[]^&" else x for x in pattern[begin:end])
            out, i = out + ("[^/" if negated else "[") + inside + "]", end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}":
            if not depth:
                raise ValueError(f"a stray bracket in {pattern!r}")
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in r".^$+(){}|[]\\" else c
        i += 1
    if depth:
        raise ValueError(f"an open alternative in {pattern!r}")
    return f"^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    """The pattern meets the relative path or the file name."""
    regex = glob_to_regex(pattern)
    return path.rlike(regex) | F.regexp_extract(path, r"([^/]*)$", 1).rlike(regex)


def read_raw(spark: SparkSession, roots: list[str], absolute_paths: bool = False, glob: str | None = None) -> DataFrame:
    """``(root, file, length, content)`` of all files below the roots that the glob meets; each root once, a missing one
    fails. Spark lists and opens the files, so any store it knows will do; see ``note_files`` for what it leaves out.

    A glob by name alone reaches the listing; one with folders is tested on the path before a file is opened.
    """
    unique = list(dict.fromkeys(posixpath.normpath(r) if "://" not in r else r.rstrip("/") for r in roots))
    out = None
    for root in unique:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
        by_name = glob is not None and "/" not in glob and "**" not in glob
        if glob is not None:
            glob_to_regex(glob)  # refuses what is not one
        files = (reader.option("pathGlobFilter", glob) if by_name else reader).load(root)
        path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
        relative = F.expr("substring(path_, length(root) + 2)")
        files = files.select(F.lit(root).alias("root"), path.alias("path_"), "length", "content")
        if glob is not None and not by_name:
            files = files.where(matches_glob(relative, glob))
        files = files.withColumn("file", F.col("path_") if absolute_paths else relative).drop("path_")
        out = files if out is None else out.unionByName(files)
    if out is None:
        raise ValueError("no root given")
    root = F.col("root") if len(unique) > 1 else F.lit(None).cast("string")
    return out.select(root.alias("root"), "file", "length", "content")


def gated(raw: DataFrame) -> DataFrame:
    """``raw`` with its ``gate`` and the text of what is parsed.

    Gates in their order: 'failed' (it could not be read), 'oversize', 'no_marker', 'not_utf8' and 'parsed'. A note
    without a marker has nothing to lose, so its bytes are not looked at further.
    """
    text = without_bom(F.col("content").cast("string"))
    failed = F.col("error").isNotNull() if "error" in raw.columns else F.lit(False)
    gate = (
        F.when(failed, "failed").when(F.col("length") > MAX_FILE_SIZE, "oversize").when(~F.coalesce(text.rlike(MARKERS), F.lit(False)), "no_marker")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8").otherwise("parsed")
    )
    return raw.withColumn("gate", gate).withColumn("text", F.when(gate == "parsed", text))


def notes(raw: DataFrame) -> DataFrame:
    """``(root, file, text)`` of the notes to parse. The size test comes first and reaches the reader."""
    small = raw.where(F.col("length") <= MAX_FILE_SIZE).where(F.is_valid_utf8(F.col("content").cast("string")))
    return small.select("root", "file", without_bom(F.col("content").cast("string")).alias("text")).where(F.col("text").rlike(MARKERS))


UNUSABLE = ("failed", "oversize", "not_utf8")


def _counters(odd_path: Column) -> list[Column]:
    gate = F.col("gate")
    failed = F.when(gate.isin(*UNUSABLE), F.col("file"))
    counted = [F.count_if(gate == g).alias(g) for g in ("parsed", "failed", "oversize", "not_utf8", "no_marker")]
    return [F.count("*").alias("files"), *counted, F.count_if(odd_path).alias("odd_paths"), F.min(failed).alias("first_failed")]


def scan_report(raw: DataFrame) -> DataFrame:
    """One row: how many files each gate took, and the first path that could not be used."""
    odd = F.col("odd_path") if "odd_path" in raw.columns else F.lit(False)
    return gated(raw).agg(*_counters(odd)).select("files", "parsed", "oversize", "not_utf8", "no_marker", "first_failed", "failed", "odd_paths")


def failed_paths(raw: DataFrame, n: int = SHOWN_PATHS) -> DataFrame:
    """The first unusable paths, ``n`` at most."""
    found = raw if "gate" in raw.columns else gated(raw)
    return found.where(F.col("gate").isin(*UNUSABLE)).select("file", "gate").orderBy("file", "gate").limit(n)


def run_report(raw: DataFrame, tasks_found: int, findings: DataFrame, cap: int) -> DataFrame:
    """``scan_report`` with the first unusable paths, the number of findings of a run made elsewhere, and whether its cap
    was reached. ``Run`` makes the run and its report in one pass."""
    shown = [r.file for r in failed_paths(raw).collect()]  # 20 at most
    warned = findings.count()
    return scan_report(raw).withColumns({
        "failed_paths": F.array(*map(F.lit, shown)).cast("array<string>"), "warnings": F.lit(warned).cast("bigint"), "cap_reached": F.lit(tasks_found >= cap),
    })


class Run:
    """One run over note files: each is opened once, and what the run reports is counted on the way.

    ``tasks`` is the run's table of tasks, cut off at the cap in the order of root, file and line. With a ``note_cap``
    the limit holds for each note instead and a run has as many tasks as its notes give. ``report`` is one row: the files
    of each gate, the first unusable paths, tasks, findings of either kind, the limit, and whether it was reached.
    """

    def __init__(self, raw: DataFrame, cap: int | None = None, note_cap: int | None = None):
        from vesperline.operators import extract, quality

        if cap and note_cap:
            raise ValueError("a run has one limit: of its tasks or of each note's")
        spark, limit = raw.sparkSession, note_cap or cap or extract.MAX_TASKS
        files, found, faults = (Observation() for _ in range(3))
        odd = F.col("odd_path") if "odd_path" in raw.columns else F.lit(False)
        # the counters ride on the one pass that reads the files
        counted = gated(raw).observe(files, *_counters(odd)).select("root", "file", "gate", "text")
        self.files = as_table(counted)
        read = extract.tasks(self.files.where("gate = 'parsed'"), limit)
        if note_cap:
            whole = as_table(read)
            most = whole.groupBy(*extract.KEY).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
            self.tasks = as_table(extract.capped_notes(whole, limit)) if most > limit else whole
            n, reached = self.tasks.count(), most >= limit
        else:
            self.tasks = as_table(extract.capped(read, limit).observe(found, F.count("*").alias("tasks")))
            n, reached = found.get["tasks"], found.get["tasks"] >= limit
        kinds = [F.count_if(F.col("channel") == c).alias(f"{c}_findings") for c in quality.CHANNELS]
        self.findings = as_table(quality.findings(self.tasks).observe(faults, *kinds))
        shown = [r.file for r in failed_paths(self.files).collect()]  # 20 at most
        counts = {**files.get, "tasks": n, **faults.get}
        values = {**{k: counts[k] for k in ("files", "parsed", "failed", "oversize", "not_utf8", "no_marker", "odd_paths", "tasks", *(f"{c}_findings" for c in quality.CHANNELS))}}
        values |= {"task_limit": limit, "cap_reached": reached}
        values["has_warnings"] = bool(values["failed"] or values["oversize"] or values["not_utf8"] or values["odd_paths"] or values["cap_reached"])
        row = [F.lit(v).cast("boolean" if isinstance(v, bool) else "bigint").alias(k) for k, v in values.items()]
        self.report = spark.range(1).select(*row, F.array(*map(F.lit, shown)).cast("array<string>").alias("failed_paths"))
