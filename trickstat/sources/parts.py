"""An ordered text sink: numbered parts and a manifest, written so that what a failed attempt left is never seen.

df.write.format("trickstat_parts").mode("overwrite").save(path), df with one column of lines in the order of its partitions
(repartitionByRange and sortWithinPartitions). Each attempt of a task writes a file of its own in a staging folder, under
its partition's number. When all tasks are through, the driver moves the files of the attempts that counted to
part-000000, part-000001, ..., then writes _manifest.json, and removes the staging folder with what else is in it. Without a
manifest there is no result: readers ask for it, and a job that fails leaves none of its own. Empty partitions have no part.

Options: header, a line before all others; terminator, what ends a line (\\n). spark.read.format("trickstat_parts").load(path)
gives part, n (from 1 in the part) and line, so a table comes back in the order in which it was written. Modes: overwrite
takes the old result away first, append is an error where one is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .lines import BATCH_LINES, filesystem

FORMAT = "trickstat_parts"
MANIFEST = "_manifest.json"


@dataclass
class Part(InputPartition):
    number: int
    name: str


@dataclass
class Written(WriterCommitMessage):
    number: int
    name: str
    rows: int
    size: int


def manifest(path: str) -> dict | None:
    store, name = filesystem(path)
    if store.get_file_info(f"{name}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with store.open_input_file(f"{name}/{MANIFEST}") as f:
        return json.loads(f.read())


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, header: str | None, terminator: str) -> None:
        self.path, self.overwrite, self.header, self.terminator = path, overwrite, header, terminator
        self.staging = f"_staging-{uuid.uuid4().hex}"
        if not overwrite and manifest(path) is not None:
            raise FileExistsError(f"{path} has a result; use mode overwrite")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = filesystem(self.path)
        number, name, rows = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        end = self.terminator.encode()
        with store.open_output_stream(f"{root}/{self.staging}/{name}") as f:
            for batch in iterator:
                lines = [(x or "").encode() for x in batch.column(0).to_pylist()]
                rows += len(lines)
                f.write(b"".join(x for line in lines for x in (line, end)))
            size = f.tell()
        return Written(number, name, rows, size)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite and (old := manifest(self.path)) is not None:
            store.delete_file(f"{root}/{MANIFEST}")
            for part in old["parts"]:
                store.delete_file(f"{root}/{part['name']}")
        parts = []
        if self.header is not None:
            with store.open_output_stream(f"{root}/part-000000") as f:
                f.write((self.header + self.terminator).encode())
            parts.append({"name": "part-000000", "rows": 1})
        for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.number):
            name = f"part-{len(parts):06d}"
            store.move(f"{root}/{self.staging}/{m.name}", f"{root}/{name}")
            parts.append({"name": name, "rows": m.rows, "bytes": m.size})
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"parts": parts, "rows": sum(p["rows"] for p in parts), "header": self.header is not None, "terminator": self.terminator}, indent=1).encode())
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class PartsReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        found = manifest(path)
        if found is None:
            raise FileNotFoundError(f"{path} has no {MANIFEST}")
        self.terminator = found["terminator"]
        self.names = [p["name"] for p in found["parts"]]

    def partitions(self) -> list[Part]:
        return [Part(i, name) for i, name in enumerate(self.names)] or [Part(-1, "")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = filesystem(self.path)
        held, n, rest, end = [], 0, b"", self.terminator.encode()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.number] * len(held), pa.int32()), pa.array(range(n - len(held) + 1, n + 1), pa.int64()), pa.array(held, pa.string())], ["part", "n", "line"])

        with store.open_input_file(f"{root}/{partition.name}") as f:
            while piece := f.read(1 << 20):
                *lines, rest = (rest + piece).split(end)
                for line in lines:
                    held.append(line.decode())
                    n += 1
                    if len(held) == BATCH_LINES:
                        yield batch()
                        held = []
        if held:
            yield batch()


class Parts(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "part int, n long, line string"

    def reader(self, schema: StructType) -> PartsReader:
        return PartsReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> PartsWriter:
        if [f.dataType.simpleString() for f in schema] != ["string"]:
            raise ValueError(f"one column of text is asked for, not {schema.simpleString()}")
        return PartsWriter(self.options["path"], overwrite, self.options.get("header"), self.options.get("terminator", "\n"))


def write_parts(lines: DataFrame, order: list[str], line: str, path: str, header: str | None = None, terminator: str = "\n", mode: str = "append") -> None:
    """Writes line of each row in the order of some columns, in ranges that are sorted by themselves."""
    lines.sparkSession.dataSource.register(Parts)
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order).select(line)
    out = rows.write.format(FORMAT).mode(mode).option("terminator", terminator)
    (out if header is None else out.option("header", header)).save(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """part, n, line of what write_parts() wrote."""
    spark.dataSource.register(Parts)
    return spark.read.format(FORMAT).load(path)
