"""Best-fit packing of documents into token sequences, certified by lower bounds.

tokenized() cuts documents into pieces; packed() places pieces into sequences: every partition runs
best-fit decreasing and compares its bin count with dual-feasible-function lower bounds. Partitions
whose count is above their bound exchange the pieces of their bins that aren't full, and run again.

Nulls: a null text is an empty document (only the closing id); rows with a null doc_id are kept, repeated
rows are packed as often as they occur. A very long text is tokenized by itself, whole; only its ids are cut. Further
columns of any name are left out. Of pieces of equal length it is open which goes where. An empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import SPACE, slices
from .shared import stored, texts

CAPACITY = 2048
END_ID = 0
#: A run of so many characters without a break, or of blanks only, goes to the tokenizer that merges in n log n steps.
LONG_RUN = 1000
#: The vocabulary's own way to part a text before merging: a fixed value of the file's format.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of a byte-level BPE vocabulary (tokenizers' JSON) as little-endian 32-bit bytes.

    The same ranks are given to a merger that is faster on plain prose; texts with the string of an added token or with
    very long runs (where that one takes quadratic time) go to the file's own tokenizer. Both give the same ids. Nothing
    is remembered between texts, so a worker's memory is the vocabulary's and one text's.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = json.loads(Path(path).read_text())
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if all(c in byte for c in token)}
        self.merger = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = [x["content"] for x in vocabulary["added_tokens"]]

    def encode(self, text: str, long_run: bool = True) -> bytes:
        if long_run or any(x in text for x in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.merger.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


def long_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts have more than LONG_RUN bytes in a row with no change between ASCII blanks and other bytes."""
    space = SPACE[data]
    edges = np.unique(np.concatenate((np.flatnonzero(space[1:] != space[:-1]) + 1, offsets)))
    long = edges[:-1][np.diff(edges) > LONG_RUN]
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, long, "right") - 1] = True
    return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One vocabulary a worker: its size doesn't depend on what was encoded."""
    return Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document. Only documents of more than capacity ids are cut; the first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part, data, offsets in slices(batch):
                rows: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, text, long in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), long_runs(data, offsets).tolist(), strict=True):
                    ids = enc.encode(text or "", long) + end
                    n = len(ids) // 4
                    at, piece = 0, 0
                    while at < n:
                        size = (n - 1) % capacity + 1 if at == 0 else capacity
                        for column, value in zip(rows, (doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                            column.append(value)
                        at, piece = at + size, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions: thresholds (items over capacity - t count whole, under t
    count nothing) and the rounding functions u(k); no packing has fewer bins."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    many, mass = np.cumsum(count[::-1])[::-1], np.cumsum((count * size)[::-1])[::-1]
    for t in range(1, capacity // 2 + 1):
        whole = int(many[capacity - t + 1])
        best = max(best, whole - (-int(mass[t] - mass[capacity - t + 1]) // capacity))
    for k in range(1, 33):
        exact = (k + 1) * size % capacity == 0
        value = np.where(exact, k * size, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin. A bit per room tells which rooms some bin has."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made, fill = 0, 0, []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            room, at, made = capacity, made, made + 1
            fill.append(0)
        bins[i], offsets[i] = at, capacity - room
        fill[at] += size
        if room > size:
            open_[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


def packed(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = 100_000) -> DataFrame:
    """pieces with sequence_id, offset and certified (its partition's count equals its lower bound).

    Pieces are dealt out by a hash, so every partition sees the same mix of lengths. Rounds shrink: only
    pieces of unfilled bins of partitions with a gap take part again, in half as many partitions or fewer, until no gap is
    left or a single partition has had its turn: its bins stand, certified or not.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    schema = f"{pieces.schema.simpleString()[7:-1].replace(':', ' ')}, sequence_id long, offset long, certified boolean, again boolean"

    def place(number: int, last: bool):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
            sizes = rows["length"].to_numpy(np.int64)
            bins, offsets, fill = best_fit(sizes, capacity)
            tight = len(fill) <= lower_bound(sizes, capacity)
            rows["sequence_id"] = bins + ((number << 52) + (int(key[0]) << 28))
            rows["offset"] = offsets
            rows["certified"] = tight
            rows["again"] = (fill[bins] < capacity) & (not tight) & (not last)
            return rows[[*columns, "sequence_id", "offset", "certified", "again"]]

        return run

    left, done = pieces, []
    parts = max(1, -(-pieces.count() // per_partition))
    for number in count(1):
        last = number > 1 and parts == 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(number)), F.lit(parts)))
        result = stored(dealt.groupBy("part").applyInPandas(place(number, last), schema), f"packed-{number}")
        done.append(result.where(~F.col("again")))
        left = result.where("again").select(*columns)
        rest = 0 if last else left.count()
        if not rest:
            break
        parts = max(1, min(parts // 2, -(-rest // per_partition)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("again")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """tokenized() and packed() in one: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    return packed(stored(tokenized(docs, vocabulary, capacity), "pieces"), capacity)
