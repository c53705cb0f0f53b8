"""WARC archives of pages, and the capture index of what was written.

archived() writes response and revisit records into WARC files through Spark's writers; each task's file is a
run sorted by URL key and time. captures() reads archives back record by record, with each record's place and length in
its (unzipped) archive, from which record_at() fetches it. merged() brings the runs into one global order: captures are
dealt out by ranges of (URL key, time, page_id), each run's part of a range is cut into blocks, and blocks are read in the
order of their first captures. A loser tree merges the runs; a block joins it when the merge has come to its first
capture, so that about one block of each run is open at a time, however long the runs are.

Nulls: a null html is an empty payload, a null url is written as "-"; a page with a null page_id never is
what others refer to. Rows that repeat a page_id with the same payload are all responses. A very long page makes its file as
long. Further columns do no harm. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, stored

#: Payloads of fewer bytes are never revisits.
LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A file takes so many bytes of pages of average length, and a block of a run so many captures.
FILE_BYTES = 64 << 20
BLOCK = 1000
CAPTURE = "run string, url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"


def url_key(url: Column) -> Column:
    """Host labels from the top domain down, then path and query, lower-cased; no scheme, port or fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "#.*$", "")
    host = F.regexp_extract(bare, r"^[a-z][a-z0-9+.-]*://(?:www\d*\.)?([^/?:]*)", 1)
    rest = F.regexp_replace(bare, r"^[a-z][a-z0-9+.-]*://[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def capture_time(seconds: Column) -> Column:
    """WARC-Date of so many seconds after the start of 2024, in any session time zone."""
    of_day = seconds % 86400
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_add(F.lit("2024-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string"), F.lit("T"), two(of_day / 3600), F.lit(":"), two(of_day % 3600 / 60), F.lit(":"), two(of_day % 60), F.lit("Z"))


def records(pages: DataFrame) -> DataFrame:
    """One row per page with its record as text; the archive's record end is the writer's line separator."""
    page = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    page = page.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    copies = page.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    page = page.join(copies, "digest", "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False)))
    page = page.withColumns({"url_key": url_key(F.col("url")), "captured_at": capture_time(F.abs(F.coalesce("page_id", F.lit(0))) % (1 << 31))})
    target = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("-")), "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), "url", "digest"), 256), F.lit(">"))),
        line("WARC-Date", F.col("captured_at")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-URL-Key", F.regexp_replace("url_key", "[\r\n]", " ")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("X-Refers-To-Page-ID", F.col("first").cast("string")))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    block = F.when(F.col("revisit"), F.col("http")).otherwise(F.concat("http", "html"))
    return page.withColumn("http", http).withColumn("block", block).select("url_key", "captured_at", "page_id", F.concat(head, F.lit("Content-Length: "), F.octet_length("block"), F.lit("\r\n\r\n"), F.col("block")).alias("record"))


def archived(pages: DataFrame, path: str, records_per_file: int = 5_000) -> str:
    """Writes gzipped WARC files under path: a sorted run each."""
    size = pages.agg(F.avg(F.octet_length(pages["html"].cast("string")))).first()[0] or 0
    run = records(pages).sortWithinPartitions("url_key", "captured_at", "page_id").select("record")
    run.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, min(records_per_file, int(FILE_BYTES // (size + 1000))))).text(path)
    return path


def _unzipped(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        member = zlib.decompressobj(31)
        while content and not member.eof:
            got = member.decompress(content, step)
            content = member.unconsumed_tail
            yield got
        content = member.unused_data


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Header fields, block, place and length of each record of an archive; Content-Length decides where a block ends."""
    data, source, at = bytearray(), _unzipped(content), 0

    def fill(size: int) -> bool:
        while len(data) < size:
            more = next(source, None)
            if more is None:
                return False
            data.extend(more)
        return True

    while fill(1):
        end = data.find(b"\r\n\r\n")
        while end < 0 and fill(len(data) + 1):
            end = data.find(b"\r\n\r\n")
        if end < 0:
            raise ValueError("a WARC record has no end of header")
        fields = dict(x.split(": ", 1) for x in data[:end].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        if not fill(end + 8 + size):
            raise ValueError("a WARC record is cut off")
        yield fields, bytes(data[end + 4 : end + 4 + size]), at, end + 8 + size
        del data[: end + 8 + size]
        at += end + 8 + size


def record_at(content: bytes, offset: int, length: int) -> bytes:
    """One record of an archive, unzipped no further than to its end."""
    out, at = bytearray(), 0
    for piece in _unzipped(content):
        out += piece[max(0, offset - at) : max(0, offset + length - at)]
        at += len(piece)
        if at >= offset + length:
            break
    return bytes(out)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under path; a response's length and digest come from its payload as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for fields, block, place, length in parsed(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, size = fields["WARC-Payload-Digest"].split(":")[1], int(head.rsplit(b": ", 1)[1])
                    if fields["WARC-Type"] == "response":
                        if (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"a payload in {name} isn't what was written")
                    rows.append((name.rsplit("/", 1)[1], fields["X-URL-Key"], fields["WARC-Date"], int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, size, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in fields else None, place, length))
                yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CAPTURE)


SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split(" ") for x in CAPTURE.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)


class LoserTree:
    """k-way merge of sorted queues of (key, value): each inner node holds the loser of its match, so a new head plays along
    one path only. Of equal keys the earlier queue's comes first."""

    def __init__(self, runs: list[deque]) -> None:
        self.runs = [r for r in runs if r]
        self.losers = [-1] * max(1, len(self.runs))
        for i in range(len(self.runs)):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.runs[a], self.runs[b]
        return bool(x) and (not y or (x[0][0], a) < (y[0][0], b)) or not x and not y and a < b

    def _play(self, winner: int) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its match
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def upto(self, key: tuple | None) -> Iterator[tuple]:
        """Values whose key is smaller than key; all, if it is None."""
        while self.runs and (run := self.runs[self.losers[0]]) and (key is None or run[0][0] < key):
            yield run.popleft()[1]
            self._play(self.losers[0])


def _key(row: tuple) -> tuple[str, str, int]:
    return row[1], row[2], -1 if row[3] is None else row[3]


def merged(index: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """index in global order of (url_key, captured_at, page_id): ranges of partitions, in each a loser-tree merge of its runs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, SCHEMA) as writer:
                writer.write_batch(_batch(rows))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
            values = (*rows[0][:4], sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["run", "url_key", "captured_at", "page_id", "block"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0] != row[0] or len(held) == block_rows):
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, deque] = {}
        tree, out = LoserTree([]), []
        for batch in batches:
            for content in batch.column("block"):
                block = pa.ipc.open_stream(content.as_py()).read_all()
                rows = [(_key(row), row) for row in zip(*(c.to_pylist() for c in block.columns), strict=True)]
                out += tree.upto(rows[0][0])
                runs = {name: run for name, run in runs.items() if run}
                runs.setdefault(rows[0][1][0], deque()).extend(rows)
                tree = LoserTree(list(runs.values()))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        for row in tree.upto(None):
            out.append(row)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    order = ["url_key", "captured_at", "page_id"]
    blocks = index.repartitionByRange(*order).sortWithinPartitions("run", *order).mapInArrow(cut, "run string, url_key string, captured_at string, page_id long, block binary")
    return blocks.sortWithinPartitions(*order, "run").select("block").mapInArrow(merge, CAPTURE)


def capture_histories(pages: DataFrame) -> DataFrame:
    """pages written as WARC, read back and merged: run, url_key, captured_at, page_id, payload_bytes, payload_digest, record_type, refers_to, offset, length."""
    spark = pages.sparkSession
    return merged(stored(captures(spark, archived(pages, shared_path(spark, "warc"))), "captures"))
