"""A data source for lines of JSON in files of any size: ``spark.read.format("ranged_json_lines")``.

A partition is a range of bytes of one file, so a large catalogue is read by many tasks; a line belongs to the range
in which it begins.  What is no JSON object, and a file that cannot be read, become rows with an ``error`` instead of
ending the job.  Comparisons of ``path`` with constants are pushed down: other files are not listed into partitions.

Files are opened through ``pyarrow.fs``, so any store that it knows by URI can be read by the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

FORMAT = "ranged_json_lines"
SCHEMA = "path string, start long, value string, error string"
#: Bytes of a range, of a read within it, and lines of a batch.
RANGE_BYTES = 64 << 20
BLOCK = 1 << 20
LINES = 2048
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


def _opened(location: str) -> tuple[pfs.FileSystem, str]:
    """The store and the path in it; a local path has no scheme."""
    if location.startswith("file:"):
        return pfs.LocalFileSystem(), "/" + location.removeprefix("file:").lstrip("/")
    return pfs.FileSystem.from_uri(location) if "://" in location else (pfs.LocalFileSystem(), location)


def lines_of(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(where it begins, the line without its end) of the lines that begin in start..stop."""
    at = max(0, start - 1)  # a line begins at ``start`` if the byte before ends one
    file.seek(at)
    held, skip = b"", start > 0
    while at < stop:
        block = file.read(BLOCK)
        held += block
        parts = held.split(b"\n")
        held = parts.pop()
        for part in parts:
            if not skip and at < stop:
                yield at, part
            skip, at = False, at + len(part) + 1
        if not block:
            if held and not skip and at < stop:
                yield at, held
            return


def object_error(line: bytes) -> tuple[str | None, str | None]:
    """(the text, what keeps it from being a JSON object)."""
    try:
        text = line.decode()
    except UnicodeDecodeError as error:
        return None, f"UnicodeDecodeError: {error.reason}"
    try:
        return text, None if isinstance(json.loads(text), dict) else "no object"
    except ValueError as error:
        return text, f"{type(error).__name__}: {str(error).split(':')[0]}"


class RangedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.location = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.wanted: set[str] | None = None

    def partitions(self) -> list[Range]:
        store, root = _opened(self.location)
        found = store.get_file_info(pfs.FileSelector(root, recursive=True))
        out = []
        for info in sorted(found, key=lambda i: i.path):
            name = info.path.removeprefix(root).lstrip("/")
            if info.type == pfs.FileType.File and not info.base_name.startswith(("_", ".")) and (self.wanted is None or name in self.wanted):
                out += [Range(name, at, min(at + self.range_bytes, info.size)) for at in range(0, max(1, info.size), self.range_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        store, root = _opened(self.location)
        rows: list[tuple] = []
        try:
            with store.open_input_file(f"{root.rstrip('/')}/{partition.path}") as file:
                for at, line in lines_of(file, partition.start, partition.stop):
                    rows.append((partition.path, at, *object_error(line)))
                    if len(rows) == LINES:
                        yield batch(rows)
                        rows = []
        except OSError as error:
            rows.append((partition.path, partition.start, None, f"{type(error).__name__}: the range cannot be read"))
        if rows:
            yield batch(rows)


class FilteringReader(RangedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Those on the path choose files; the others are left to Spark."""
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("path",):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield one


class RangedLines(DataSource):
    """Options: ``path`` (a folder), ``rangeBytes``, ``pushFilters`` (Spark wants it told that a source takes filters)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangedReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (FilteringReader if options.get("pushfilters") == "true" else RangedReader)(options)


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, value, error of every line under a folder.  Filters on ``path`` reach the source where the session
    has ``spark.sql.python.filterPushdown.enabled``."""
    spark.dataSource.register(RangedLines)
    return spark.read.format(FORMAT).option("rangeBytes", range_bytes).option("pushFilters", spark.conf.get(_PUSHDOWN, "false")).load(path)
