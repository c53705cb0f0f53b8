"""Text lines as a data source that reads byte ranges: numbers of lines come from counts of ranges, not from a second copy.

spark.read.format("trickstat_lines").load(path) has file, start (of the range, in bytes), n and filled (the line's number and
the number of lines that aren't empty, both from 1 within the range) and line. With option counts=true it has a row per range
instead: file, start, lines, filled, and n, filled and text of its first line with a comma (head_n, head_filled, head). A range owns the lines that begin in it. Files are listed by name on the driver; data is
read by tasks only, in pieces of READ_BYTES, so memory depends on the longest line, not on the file or the range.

path: a file, a folder (with its subfolders), or several of them separated by commas; local, or on any store that pyarrow can
open by URI. Names that begin with _ or . are left out. Bytes that aren't UTF-8 become replacement characters; \\n and \\r\\n end a
line; a byte order mark is dropped. Empty files have no lines.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.keys import with_sums_before
from ..streaming.tables import stored

FORMAT = "trickstat_lines"
RANGE_BYTES = 64 << 20
READ_BYTES = 1 << 20
TASK_BYTES = 16 << 20
LEAST_TASKS = 32
BATCH_LINES = 1 << 14
BATCH_BYTES = 4 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and its name there."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return pafs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, str, int]]:
    """(path to open, name, size) of all files, by name."""
    out = []
    for one in path.split(","):
        store, name = filesystem(one.strip())
        prefix = one.strip()[: len(one.strip()) - len(name)] if one.strip().endswith(name) else ""
        info = store.get_file_info(name)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(one)
        files = [info] if info.is_file else store.get_file_info(pafs.FileSelector(name, recursive=True))
        hidden = lambda p: any(part[:1] in ("_", ".") for part in posixpath.relpath(p, name).split("/") if part != ".")
        out += [(prefix + f.path, f.path, f.size) for f in files if f.is_file and not hidden(f.path)]
    return sorted(out, key=lambda f: f[1])


@dataclass
class Range:
    path: str
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """Ranges of one task."""

    ranges: list[Range]


def lines_of(path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines that begin at start or later and before end, without what ends them."""
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        at = start
        if start:  # a line begins after each line feed, so look from the byte before on
            at = start - 1
            f.seek(at)
            while True:
                piece = f.read(READ_BYTES)
                if not piece:
                    return
                if (i := piece.find(b"\n")) >= 0:
                    at += i + 1
                    break
                at += len(piece)
        f.seek(at)
        rest: list[bytes] = []  # of the line that begins at `at`
        while at < end:
            piece = f.read(READ_BYTES)
            if not piece:
                if rest:
                    yield b"".join(rest).removesuffix(b"\r")
                return
            first, *more = piece.split(b"\n")
            rest.append(first)
            for part in more:
                line = b"".join(rest)
                yield line.removesuffix(b"\r")
                at += len(line) + 1
                if at >= end:
                    return
                rest = [part]
            if rest == [b""]:
                rest = []


class LineReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, counts: bool) -> None:
        self.path, self.range_bytes, self.counts = path, range_bytes, counts

    def partitions(self) -> list[Ranges]:
        """Small ranges share a task, TASK_BYTES of them at most; of few there is still a task for each of LEAST_TASKS parts."""
        out = [Range(path, low, min(low + self.range_bytes, size)) for path, _, size in listed(self.path) for low in range(0, size, self.range_bytes)]
        each = max(min(TASK_BYTES // self.range_bytes, len(out) // LEAST_TASKS), 1)
        return [Ranges(out[i : i + each]) for i in range(0, len(out), each)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._read(one)

    def _read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        name, held, size, n, filled = filesystem(partition.path)[1], [], 0, 0, 0
        head: tuple = (None, None, None)
        columns = ["file", "start", "n", "filled", "line"]

        def batch() -> pa.RecordBatch:
            k = len(held)
            return pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array([partition.start] * k, pa.int64()), *(pa.array([h[i] for h in held], pa.int64()) for i in (0, 1)), pa.array([h[2] for h in held], pa.string())], columns)

        for line in lines_of(partition.path, partition.start, partition.end):
            if n == 0 and partition.start == 0:
                line = line.removeprefix(b"\xef\xbb\xbf")
            n, filled = n + 1, filled + bool(line)
            if self.counts:
                if head[0] is None and b"," in line:
                    head = (n, filled, line.decode("utf-8", "replace"))
            else:
                held.append((n, filled, line.decode("utf-8", "replace")))
                size += len(line)
                if len(held) == BATCH_LINES or size > BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
        if self.counts:
            yield pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (partition.start, n, filled, *head[:2])), pa.array([head[2]], pa.string())], ["file", "start", "lines", "filled", "head_n", "head_filled", "head"])
        elif held:
            yield batch()


class Lines(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _counts(self) -> bool:
        return self.options.get("counts", "false").lower() == "true"

    def schema(self) -> str:
        return "file string, start long, lines long, filled long, head_n long, head_filled long, head string" if self._counts() else "file string, start long, n long, filled long, line string"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)), self._counts())


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, counts: bool = False) -> DataFrame:
    spark.dataSource.register(Lines)
    return spark.read.format(FORMAT).option("range_bytes", range_bytes).option("counts", str(counts).lower()).load(path)


def counted_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A row per range, with the lines (_lines) and those that aren't empty (_filled) before it in its file. Stored: a second use doesn't read the input again."""
    counts = stored(read_lines(spark, path, range_bytes, True), "ranges")
    return with_sums_before(counts, {"lines": "_lines", "filled": "_filled"}, "start", "file")


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, ranges: DataFrame | None = None) -> DataFrame:
    """file, line_no (from 1, in file order), filled_no (the same, of lines that aren't empty), line.

    The input is read twice and stored never: once to count the lines of each range, which are then added up over the
    ranges of a file, and once for the lines themselves. What is joined to them is a row per range."""
    ranges = counted_ranges(spark, path, range_bytes) if ranges is None else ranges
    rows = read_lines(spark, path, range_bytes).join(ranges.select("file", "start", "_lines", "_filled"), ["file", "start"])
    return rows.select("file", (F.col("_lines") + F.col("n")).alias("line_no"), (F.col("_filled") + F.col("filled")).alias("filled_no"), "line")
