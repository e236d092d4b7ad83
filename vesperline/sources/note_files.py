"""A data source of note files that outlives bad ones: ``spark.read.format("note_files")``, one row a file.

Spark's own file readers drop names that begin with ``_``, follow links, and end the job at a file they cannot open.
This one lists the roots itself and gives a row for every file that the glob meets: its content, or why there is none.
Paths need a file system that Python opens, mounted or known to Arrow; for other stores there is ``notes.read_raw``.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, file string, length long, content binary, error string, odd_path boolean"
_ARROW = pa.schema([("root", pa.string()), ("file", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("error", pa.string()), ("odd_path", pa.bool_())])
_FILES, _BYTES, _BATCH = 4096, 64 << 20, 16 << 20  # of a partition at most, and of a batch of rows


def canonical_root(root: str) -> str:
    """A root as the file system names it: ``.``, ``..``, links and a ``file:`` scheme resolved. A missing one is refused."""
    scheme, _, rest = root.partition("://")
    if rest and scheme != "file":
        import pyarrow.fs as afs

        fs, path = afs.FileSystem.from_uri(f"{scheme}://{posixpath.normpath(rest)}")
        if fs.get_file_info(path).type != afs.FileType.Directory:
            raise ValueError(f"not a directory: {root}")
        return f"{scheme}://{posixpath.normpath(rest)}"
    found = os.path.realpath(re.sub("^file:/*", "/", root))
    if not os.path.isdir(found):
        raise ValueError(f"not a directory: {root}")
    return found


def canonical_roots(roots: list[str]) -> list[str]:
    """Each root once, in order; a root within another one stays a root of its own."""
    found = list(dict.fromkeys(map(canonical_root, roots)))
    if not found:
        raise ValueError("no root given")
    return found


def _walk(root: str) -> Iterator[tuple[str, int, str | None]]:
    """(path below the root, size, error) of the files below a root, by name. Hidden entries are left out, and so are
    links and what is mounted from elsewhere; a folder that cannot be listed is an error of its own."""
    if "://" in root:
        import pyarrow.fs as afs

        fs, base = afs.FileSystem.from_uri(root)
        for info in sorted(fs.get_file_info(afs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            below = info.path[len(base) :].lstrip("/")
            if info.is_file and not any(part.startswith(".") for part in below.split("/")):
                yield below, info.size, None
        return
    device, waiting = os.stat(root).st_dev, [root]
    while waiting:
        here = waiting.pop()
        try:
            with os.scandir(here) as entries:
                found = sorted(entries, key=lambda e: e.name)
        except OSError as e:
            yield os.path.relpath(here, root), 0, f"{type(e).__name__}: {e.strerror}"
            continue
        folders = []
        for entry in found:
            if entry.name.startswith(".") or entry.is_symlink():
                continue
            try:
                about = entry.stat(follow_symlinks=False)
            except OSError as e:  # gone since it was listed
                yield os.path.relpath(entry.path, root), 0, f"{type(e).__name__}: {e.strerror}"
                continue
            if entry.is_dir(follow_symlinks=False) and about.st_dev == device:
                folders.append(entry.path)
            elif entry.is_file(follow_symlinks=False):
                yield os.path.relpath(entry.path, root), about.st_size, None
        waiting += reversed(folders)


@dataclass
class _Files(InputPartition):
    root: str
    files: list[tuple[str, int, str | None]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["roots"].split("\n")
        self.glob, self.cap = options.get("glob"), int(options["cap"])
        self.absolute, self.labelled = options.get("absolute") == "true", len(self.roots) > 1

    def _meets(self, path: str) -> bool:
        return self.glob is None or bool(re.search(self.glob, path) or re.search(self.glob, path.rsplit("/", 1)[-1]))

    def partitions(self) -> list[_Files]:
        """Files that the glob meets, as many to a partition as a task reads with ease."""
        out: list[_Files] = []
        for root in self.roots:
            files, size = [], 0
            for path, length, error in _walk(root):
                if error is None and not self._meets(path):
                    continue
                files.append((path, length, error))
                size += length if length <= self.cap else 0
                if len(files) == _FILES or size >= _BYTES:
                    out.append(_Files(root, files))
                    files, size = [], 0
            if files:
                out.append(_Files(root, files))
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, length, error in partition.files:
            content = None
            if error is None:
                content, error, length = _content(partition.root, path, self.cap, length)
            shown = (f"{partition.root}/{path}" if self.absolute else path).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            odd = path != path.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
            rows.append((partition.root if self.labelled else None, shown, length, content, error, odd))
            size += len(content or b"")
            if size >= _BATCH:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _content(root: str, path: str, cap: int, listed: int) -> tuple[bytes | None, str | None, int]:
    """(content, why it cannot be read, length) of a file. It may have grown since it was listed: what is read counts. A
    file over the cap has no content, and none of one that says so when it is opened is read."""
    try:
        if "://" in root:
            import pyarrow.fs as afs

            fs, base = afs.FileSystem.from_uri(root)
            with fs.open_input_stream(f"{base}/{path}") as f:
                content = f.read(cap + 1)
        else:
            with open(os.path.join(root, path), "rb") as f:
                size = os.fstat(f.fileno()).st_size
                if size > cap:
                    return None, None, max(listed, cap + 1)
                content = f.read(size + 1)
                if len(content) > size:
                    content += f.read(cap + 1 - len(content))
    except OSError as e:
        return None, f"{type(e).__name__}: {e.strerror or e}", listed
    return (content, None, len(content)) if len(content) <= cap else (None, None, max(listed, len(content)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class NoteFiles(DataSource):
    """Options: ``roots`` (one a line), ``glob`` (a regular expression for a path or a name), ``cap``, ``absolute``."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_files(spark: SparkSession, roots: list[str], glob: str | None = None, absolute_paths: bool = False, cap: int | None = None) -> DataFrame:
    """``(root, file, length, content, error, odd_path)`` of every file below the roots that the glob meets.

    Roots are resolved before anything is read, each once, and a missing one fails; with a single root ``root`` is null.
    A file that cannot be opened or is gone has an ``error`` and no content, one over the cap has neither; a name that is
    not UTF-8 is shown with U+FFFD and marked. Nothing ends the run.
    """
    from vesperline.sources.notes import MAX_FILE_SIZE, glob_to_regex

    spark.dataSource.register(NoteFiles)
    reader = spark.read.format("note_files").option("roots", "\n".join(canonical_roots(roots))).option("cap", cap or MAX_FILE_SIZE)
    if glob is not None:
        reader = reader.option("glob", glob_to_regex(glob))
    return reader.option("absolute", str(absolute_paths).lower()).load()
