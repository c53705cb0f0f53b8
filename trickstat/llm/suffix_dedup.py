"""Repeated byte strings of a least length across documents, by suffix arrays over shared contexts.

Every window of `least` bytes is dealt to its minimizer, the position of the smallest hash of KGRAM bytes in
it. Equal windows have equal minimizers, so all windows that may be equal meet under one key. What travels is
a minimizer's context, the bytes that its windows cover; only contexts whose key occurs again leave their
task, and of equal contexts in one task only the first does.

Where contexts of a key meet, a suffix array of their windows is built by prefix doubling. A class of equal
windows counts only if it is left-diverse (two of its members have different bytes before them, or one has no
byte before it); the others are part of a longer repeat. Over the members of such classes, in suffix order
with common-prefix lengths, a stack scan finds the tree of common-prefix intervals. Each interval that is
left-diverse is a repeat that can't be extended to the left. An occurrence that is not the first of its interval
is removed for the interval's length: removed_runs(), deduplicated().

A context ends where its windows end, so a long repeat is removed in parts, one per minimizer, which together cover it.
maximal_repeats() goes beyond: the members of left-diverse classes are the places where maximal repeats may begin; what
follows them is sorted by Spark as far as it is shared, and one scan over it reports each interval whole, with all occurrences.

Very long texts are gone through in blocks that overlap by a window. Order of occurrences: doc_id (null before all
others), then start. Rows with equal doc_id and text are one document and get the same result; with equal doc_id and
other text they are documents of their own. A null text is empty. An empty table gives no rows. Further columns are left
out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import _BYTE, by_bucket, mix, pack, powers, slices, spans_hash, unpack
from .shared import buckets, marked, stored

LEAST = 100
KGRAM = 20
BLOCK = 1 << 20
BLOOM_BITS = 1 << 27
CHUNK = 1 << 12
SPAN = 1 << 14
_POSITION = np.uint64(BLOCK * 2 - 1)
NO_ID = -(1 << 63)


def anchors(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and last window of each minimizer; windows never cross texts."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for block in range(0, len(data), BLOCK):
        part = data[block : block + BLOCK + least - 1]
        if len(part) < least:
            continue
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=total[1:])
        grams = mix((total[KGRAM:] - total[:-KGRAM]) * down[: len(part) - KGRAM + 1])
        low = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        span, size = least - KGRAM + 1, 1
        while size * 2 <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if span > size:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        windows = np.flatnonzero(np.arange(block + least, block + least + len(low)) <= ends[block : block + len(low)])
        if not len(windows):
            continue
        at = (low[windows] & _POSITION).astype(np.int64)
        new = np.concatenate(([True], (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)))
        first = np.flatnonzero(new)
        out.append((grams[at[first]], windows[first] + block, windows[np.append(first[1:], len(windows)) - 1] + block))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bucket(keys: np.ndarray, count: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(count)).astype(np.int64)


def repeated_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """bit: places in a Bloom filter of minimizer keys that occur at least twice in all documents."""
    count = buckets(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            order, first = by_bucket(_bucket(keys, count), count)
            keys, times = keys[order].astype(np.uint32), np.minimum(times[order], 2).astype(np.uint8)
            full = [b for b in range(count) if first[b] < first[b + 1]]
            payloads = []
            for b in full:
                own = slice(first[b], first[b + 1])
                sort = np.argsort(keys[own])
                payloads.append(pack(np.diff(keys[own][sort], prepend=np.uint32(0)).astype(np.uint32), times[own][sort]))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for _, data, offsets in slices(batch):
                held.append(anchors(data, offsets, least)[0])
                size += len(held[-1])
            if size > 500_000:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        got = [unpack(p, np.uint32, np.uint8) for p in table.column("payload").to_pylist()]
        key, at = np.unique(np.concatenate([np.cumsum(g[0], dtype=np.uint32) for g in got]), return_inverse=True)
        many = key[np.bincount(at, np.concatenate([g[1] for g in got])) > 1]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bit": pa.array(np.unique(_bit(many.astype(np.uint64), np.uint64(bucket))))})

    return docs.mapInArrow(gather, "bucket int, payload binary").groupBy("bucket").applyInArrow(add, "bit long")


def _bit(low: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (mix(low | bucket << np.uint64(32)) % np.uint64(BLOOM_BITS)).astype(np.int64)


def bloom(bits: DataFrame) -> np.ndarray:
    """A filter of BLOOM_BITS from a column of places: BLOOM_BITS / 32768 rows at most, of 4 KB, come to the driver."""
    place = F.col("bit") + 1  # bitmap positions count from 1
    rows = bits.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in rows.toLocalIterator():
        low = (row["at"] - 1) * 4096
        out[low : low + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _in(filter_: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (filter_[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    before = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each document that touch or overlap made one; doc is any non-negative number."""
    if not len(doc):
        return doc, start, end
    wide = int(end.max()) + 2
    order = np.lexsort((start, doc))
    doc, low, high = doc[order], start[order] + doc[order] * wide, end[order] + doc[order] * wide
    reach = np.maximum.accumulate(high)
    new = np.concatenate(([True], low[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return doc[first], low[first] - doc[first] * wide, reach[np.append(first[1:], len(doc)) - 1] - doc[first] * wide


def contexts(docs: DataFrame, filter_: np.ndarray, least: int = LEAST, every: bool = False) -> DataFrame:
    """bucket, payload: the contexts whose key passes the filter, and the runs of those that a task has seen before in itself (none
    with every: then those go as contexts too, all with the byte before them, 256 where a text begins)."""
    count = buckets(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = sent.value
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            key, doc, mark, start, windows, content, front = (np.concatenate([h[i] for h in held]) for i in range(7))
            sizes = windows.astype(np.int64) + least - 1
            at = np.concatenate(([0], np.cumsum(sizes)))
            code = spans_hash(content, at[:-1], at[1:])
            order = np.lexsort((start, mark, doc, code))
            again = np.zeros(len(key), bool)
            again[order[1:]] = (code[order[1:]] == code[order[:-1]]) & (not every)
            bucket = _bucket(key, count)
            ids = np.stack((doc, mark), 1)
            _, own = np.unique(ids[again], axis=0, return_inverse=True) if again.any() else (None, np.zeros(0, np.int64))
            names = np.unique(ids[again], axis=0) if again.any() else np.zeros((0, 2), np.int64)
            run_doc, run_start, run_end = _merged(own.ravel(), start[again].astype(np.int64), start[again].astype(np.int64) + sizes[again])
            run_bucket = run_doc % count
            full, payloads = [], []
            fresh = np.flatnonzero(~again)
            by, first = by_bucket(bucket[fresh], count)
            run_by, run_first = by_bucket(run_bucket, count)
            for b in range(count):
                rows, runs = fresh[by[first[b] : first[b + 1]]], run_by[run_first[b] : run_first[b + 1]]
                if len(rows) or len(runs):
                    full.append(b)
                    payloads.append(pack(key[rows], doc[rows], mark[rows], start[rows], windows[rows], content[_spread(at[rows], sizes[rows])], names[run_doc[runs], 0], names[run_doc[runs], 1], run_start[runs], run_end[runs], *([front[rows]] if every else [])))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for part, data, offsets in slices(batch):
                key, low, high = anchors(data, offsets, least)
                keep = _in(filter_, _bit(key & np.uint64(0xFFFFFFFF), _bucket(key, count).astype(np.uint64)))
                key, low, high = key[keep], low[keep], high[keep]
                if not len(key):
                    continue
                of = np.searchsorted(offsets, low, "right") - 1
                doc = part.column("doc_id").fill_null(NO_ID).to_numpy()[of]
                front = np.where(low > offsets[of], data[low - 1].astype(np.uint16), np.uint16(256))
                held.append([key, doc, part.column("mark").to_numpy()[of], low - offsets[of], (high - low + 1).astype(np.uint32), data[_spread(low, high - low + least)], front])
                size += len(held[-1][5])
                if size > 5_000_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return docs.mapInArrow(run, "bucket int, payload binary")


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of pairs of ranks."""
    return np.unique(a * np.int64(len(a) + 1) + b, return_inverse=True)[1]


def windows_order(content: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """Rank of the `least` bytes at each place, by prefix doubling over the whole content (equal windows, equal ranks)."""
    padded = np.concatenate((content, np.zeros(least + 8, np.uint8)))
    word = np.zeros(len(content) + least, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | padded[i : i + len(word)]
    rank, size = np.unique(word, return_inverse=True)[1].astype(np.int64), 8
    while size * 4 <= least:
        rank = _ranks(rank[:-size], rank[size:])
        size *= 2
    if size * 2 <= least:
        low, size2 = _ranks(rank[places], rank[places + size]), size * 2
        return _ranks(low, _ranks(rank[places + least - size2], rank[places + least - size])) if size2 < least else low
    return _ranks(rank[places], rank[places + least - size])


def interval_scan(prefix: list[int], order: list[int]) -> list[int]:
    """Stack scan over neighbours in suffix order. prefix[i]: common length of i - 1 and i (0 parts them); order: which
    occurrence is earlier. Returns for each suffix the depth of the deepest interval in which it isn't the first, 0 if
    it is the first everywhere."""
    lost = [0] * len(order)
    stack: list[list[int]] = []  # depth, first suffix in text order
    for i in range(1, len(order) + 1):
        depth = prefix[i] if i < len(order) else 0
        best = i - 1
        while stack and stack[-1][0] > depth:
            top, other = stack.pop()
            if order[other] < order[best]:
                best, other = other, best
            lost[other] = top
        if depth:
            if stack and stack[-1][0] == depth:
                other = stack[-1][1]
                if order[other] < order[best]:
                    best, other = other, best
                lost[other] = depth
                stack[-1][1] = best
            else:
                stack.append([depth, best])
    return lost


def _classes(windows: np.ndarray, content: np.ndarray, least: int, front: np.ndarray | int = 256) -> tuple[np.ndarray, ...]:
    """Of all windows in classes of several that are left-diverse: rank of the class, place in content, context, byte before
    (front: that of each context, 256 for none); and where contexts begin in content."""
    base = np.concatenate(([0], np.cumsum(windows + least - 1)))
    of = np.repeat(np.arange(len(windows)), windows)
    place = _spread(base[:-1], windows)
    rank = windows_order(content, place, least)
    times = np.bincount(rank)
    pick = np.flatnonzero(times[rank] > 1)
    rank, place, of = rank[pick], place[pick], of[pick]
    before = np.where(place > base[of], content[place - 1].astype(np.int64), front[of] if isinstance(front, np.ndarray) else front)
    low, high = np.full(len(times), 300), np.full(len(times), -1)
    np.minimum.at(low, rank, before)
    np.maximum.at(high, rank, before)
    pick = np.flatnonzero(((high == 256) | (low != high))[rank])
    return rank[pick], place[pick], of[pick], before[pick], base


def _scan(key: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray, windows: np.ndarray, content: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct contexts: (context, offset in it, length) of what is removed."""
    rank, place, of, _, base = _classes(windows, content, least)
    if not len(rank):
        return (np.zeros(0, np.int64),) * 3
    left = base[of + 1] - place - least
    deep = least - 19
    wide = np.concatenate((content, np.zeros(2 * least, np.uint8)))[(place + least)[:, None] + np.arange(deep)]
    wide[np.arange(deep) >= left[:, None]] = 0
    tail = np.ascontiguousarray(np.pad(wide, ((0, 0), (0, -deep % 8)))).view(">u8")
    order = np.lexsort((left, *tail.T[::-1], rank))
    rank, place, of, left, wide = rank[order], place[order], of[order], left[order], wide[order]
    apart = wide[1:] != wide[:-1]
    same = np.where(apart.any(1), apart.argmax(1), deep)
    prefix = np.concatenate(([0], np.where(rank[1:] == rank[:-1], least + np.minimum(same, np.minimum(left[1:], left[:-1])), 0)))
    when = np.empty(len(place), np.int64)
    when[np.lexsort((start[of] + place - base[of], mark[of], doc[of]))] = np.arange(len(place))
    lost = np.array(interval_scan(prefix.tolist(), when.tolist()), np.int64)
    hit = np.flatnonzero(lost)
    return of[hit], (place - base[of])[hit], lost[hit]


def _met(table: pa.Table, every: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Contexts (with the byte before them if every), and runs."""
    kinds = (np.uint64, np.int64, np.int64, np.int64, np.uint32, np.uint8, np.int64, np.int64, np.int64, np.int64, *([np.uint16] if every else []))
    got = [unpack(p, *kinds) for p in table.column("payload").to_pylist()]
    merged = [np.concatenate([g[i] for g in got]) for i in range(len(kinds))]
    return merged[:6] + merged[10:], merged[6:10]


def _by_key(fields: list[np.ndarray], least: int, limit: int = 600_000) -> Iterator[list[np.ndarray]]:
    """Contexts of keys that several have, whole keys together, up to limit bytes or one key."""
    key, doc, mark, start, windows, content, *more = fields
    sizes = windows.astype(np.int64) + least - 1
    at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    order = np.argsort(key, kind="stable")
    keys = key[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(keys)))
    order = order[np.repeat(many > 1, many)]
    many = many[many > 1]
    stops = np.cumsum(many)
    mass = np.concatenate(([0], np.cumsum(sizes[order])))[np.concatenate(([0], stops))]
    k = 0
    while k < len(many):
        to = max(k + 1, int(np.searchsorted(mass, mass[k] + limit, "right")) - 1)
        rows = order[(stops[k - 1] if k else 0) : stops[to - 1]]
        yield [key[rows], doc[rows], mark[rows], start[rows], windows[rows].astype(np.int64), content[_spread(at[rows], sizes[rows])], *(x[rows] for x in more)]
        k = to


def removed_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, mark, low, high: byte runs (they may overlap) that lie in a string of `least` bytes that starts earlier too."""

    def meet(table: pa.Table) -> pa.Table:
        fields, known = _met(table)
        doc, mark, low, high = ([x] for x in known)
        for key, d, m, start, windows, content in _by_key(fields, least):
            sizes = windows + least - 1
            at = np.concatenate(([0], np.cumsum(sizes)))
            code = spans_hash(content, at[:-1], at[1:])
            order = np.lexsort((start, m, d, code))
            again = np.zeros(len(key), bool)
            again[order[1:]] = code[order[1:]] == code[order[:-1]]
            for column, values in zip((doc, mark, low, high), (d[again], m[again], start[again], (start + sizes)[again]), strict=True):
                column.append(values)
            rows = np.flatnonzero(~again)
            _, own, times = np.unique(key[rows], return_inverse=True, return_counts=True)
            rows = rows[times[own] > 1]
            if len(rows):
                of, offset, size = _scan(key[rows], d[rows], m[rows], start[rows], windows[rows], content[_spread(at[rows], sizes[rows])], least)
                from_ = start[rows][of] + offset
                for column, values in zip((doc, mark, low, high), (d[rows][of], m[rows][of], from_, from_ + size), strict=True):
                    column.append(values)
        return pa.table({"doc_id": np.concatenate(doc), "mark": np.concatenate(mark), "low": np.concatenate(low), "high": np.concatenate(high)})

    filter_ = bloom(repeated_keys(docs, least))
    return contexts(docs, filter_, least).groupBy("bucket").applyInArrow(meet, "doc_id long, mark long, low long, high long")


def _place(doc_id: Column, mark: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, mark), F.lit(BLOOM_BITS))


def _passing(rows: DataFrame, filter_: Broadcast, hit: bool) -> DataFrame:
    """Rows whose bit is in the filter (hit), or isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = _in(filter_.value, batch.column("bit").to_numpy())
            yield batch.filter(pa.array(inside == hit))

    return rows.mapInArrow(run, rows.schema)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


TREE = "class long, rank long, id long, mark long, start long, before int, node long, depth int, first long, last long"


def interval_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stack scan over suffixes in the order of (class, piece), a row at a time; only the stack and the row before are held.

    Gives each suffix back with its rank in its class, and a row (node, depth, ranks of the first and the last suffix) for each
    common-prefix interval that is left-diverse. depth counts from the beginning of the pieces.
    """
    names = [x.split(" ")[0] for x in TREE.split(", ")]
    kinds = [pa.int32() if n in ("before", "depth") else pa.int64() for n in names]
    nodes = TaskContext.get().partitionId() << 40
    stack: list[list[int]] = []  # depth, first rank, smallest and largest byte before
    class_, rank, piece, byte = None, 0, b"", 0
    out: list[tuple] = []

    def close(depth: int) -> None:
        nonlocal nodes
        first, low, high = rank, byte, byte
        while stack and stack[-1][0] > depth:
            top, first, a, b = stack.pop()
            low, high = min(low, a), max(high, b)
            if high == 256 or low != high:
                nodes += 1
                out.append((class_, None, None, None, None, None, nodes, top, first, rank))
        if depth < 0:
            return
        if stack and stack[-1][0] == depth:
            stack[-1][2:] = min(low, stack[-1][2]), max(high, stack[-1][3])
        else:
            stack.append([depth, first, low, high])

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("class", "id", "mark", "start", "before")]
        for row, cell in zip(zip(*columns, strict=True), batch.column("piece"), strict=True):
            next_ = cell.as_py()
            same = row[0] == class_
            if class_ is not None:
                close(_shared(piece, next_) if same else -1)
            class_, rank, piece, byte = row[0], rank + 1 if same else 0, next_, row[4]
            out.append((class_, rank, *row[1:], None, None, None, None))
            if len(out) > 20_000:
                yield made()
                out.clear()
    if class_ is not None:
        close(-1)
        yield made()


def maximal_repeats(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """repeat_id, length, doc_id, start (in bytes): every maximal repeat of `least` bytes or more, a row per occurrence.

    A maximal repeat is a string that two or more places have, and that is longer nowhere for all of them: two of its places
    have different bytes (or one of them none) before it, and two have different bytes (or one has none) after it. Repeats
    within others that have further occurrences are groups of their own, and occurrences may overlap.

    What follows the places is read `chunk` bytes a round, then 16 times more each round; only places that are equal so far
    go on, so short repeats take one round and the longest repeat decides on the number. Spark sorts the suffixes (and
    spills); the scan holds a stack. Work and result grow with the occurrences, of which copies with many differences have
    many. Contexts of one minimizer meet in one task, here with all their copies.
    """

    def meet(table: pa.Table) -> pa.Table:
        number, rows = table.column("bucket")[0].as_py() << 40, [np.zeros((0, 5), np.int64)]
        for _, doc, mark, start, windows, content, front in _by_key(_met(table, True)[0], least):
            rank, place, of, before, base = _classes(windows, content, least, front.astype(np.int64))
            if len(rank):
                rows.append(np.unique(np.stack((rank + number, doc[of], mark[of], start[of] + place - base[of], before), 1), axis=0))
                number += int(rank.max()) + 1
        found = np.concatenate(rows)
        return pa.table({n: pa.array(found[:, i], pa.int32() if n == "before" else pa.int64()) for i, n in enumerate(("class", "id", "mark", "start", "before"))})

    docs = marked(docs)
    members = stored(contexts(docs, bloom(repeated_keys(docs, least)), least, True).groupBy("bucket").applyInArrow(meet, "class long, id long, mark long, start long, before int"), "places")
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(members.select(_place(F.col("id"), F.col("mark")).alias("bit")).distinct()))
    rows = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("bit", _place(F.col("id"), F.col("mark")))
    whole = _passing(rows.select("id", "mark", "bit", "text"), filter_, True).groupBy("id", "mark").agg(F.any_value("text").cast("binary").alias("content"))
    depth, found = least, []
    while True:
        piece = F.substring("content", (F.col("start") + depth + 1).cast("int"), F.lit(chunk))
        pieces = members.join(whole, ["id", "mark"]).select("class", "id", "mark", "start", "before", piece.alias("piece"))
        tree = stored(pieces.repartition("class").sortWithinPartitions("class", "piece").mapInArrow(interval_tree, TREE), "tree")
        nodes = tree.where("node is not null").select("class", "node", "depth", "last", F.explode(F.sequence("first", "last", F.lit(SPAN))).alias("low"))
        nodes = nodes.select("class", "node", "depth", F.explode(F.sequence("low", F.least(F.col("low") + SPAN - 1, "last"))).alias("rank"))
        each = nodes.join(tree.where("node is null").drop("node", "depth"), ["class", "rank"])
        done = each.where(F.col("depth") < chunk)
        found.append(done.select((F.col("node") * 16 + len(found)).alias("repeat_id"), (F.col("depth") + depth).cast("long").alias("length"), F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "start"))
        members = stored(each.where(F.col("depth") == chunk).select(F.col("node").alias("class"), "id", "mark", "start", "before"), "places")
        if members.isEmpty():
            return reduce(DataFrame.unionByName, found)
        depth, chunk = depth + chunk, chunk * 16


def deduplicated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256. Only texts that lose bytes (and a few that a filter lets through) are shuffled."""
    docs = marked(docs)
    runs = stored(removed_runs(docs, least), "runs")
    filter_ = docs.sparkSession.sparkContext.broadcast(bloom(runs.select(_place(F.col("doc_id"), F.col("mark")).alias("bit")).distinct()))
    rows = docs.withColumn("id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("bit", _place(F.col("id"), F.col("mark")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("doc_id", "text", "runs")]
            out: list[tuple] = []
            for doc_id, text, found in zip(*columns, strict=True):
                data, kept, at, removed = text.encode(), hashlib.sha256(), 0, []
                for low, high in sorted((r["low"], r["high"]) for r in found or ()):
                    if removed and low <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], high)
                    else:
                        removed.append([low, high])
                for low, high in removed:
                    kept.update(data[at:low])
                    at = high
                kept.update(data[at:])
                out.append((doc_id, len(data), sum(b - a for a, b in removed), len(removed), kept.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    listed = runs.groupBy(F.col("doc_id").alias("id"), "mark").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    touched = _passing(rows, filter_, True).join(listed, ["id", "mark"], "left").select("doc_id", "text", "runs").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = _passing(rows, filter_, False).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return touched.unionByName(whole)
