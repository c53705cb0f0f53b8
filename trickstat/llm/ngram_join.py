"""Exact Jaccard self-join of documents on word shingles, by token-combination prefixes.

All shingles have one global order: those that fewer sets have first, then by hash. Two sets with
Jaccard t or more differ in at most d = n - ceil(t n) of the n shingles of either. A prefix is extended until
its credit is d + e, where a rare shingle gives 1 and a class of frequent shingles, dealt into small
subclasses, gives c - (k - 1) for c members of a subclass. Then the common part of two such prefixes still
has the credit e: rare shingles are indexed singly, frequent ones by their combinations of k, and as c members
have at least c - (k - 1) combinations, two sets that can link share at least e = 1 + d // 4 signatures.
Candidates that do are verified on the whole texts.

How many sets have a shingle is counted over all documents: shingles meet by key and the counts go back to the sets.
A shingle that no other set has can't be common to two: such shingles are first in the order, give their credit and
need no index. A set with more of them than d + e - 1 has no link at all. Nothing is broadcast for this.

Subclasses are numbered within a size scheme: schemes grow by 1/t, a set takes part in its own and the next,
so any two sets that can link share one.

Two shingles of a set may have one key. Prefixes are taken of a set's distinct keys: what two sets share loses no more
keys that way than either set does, so a linked set still lacks d of them at most.

A set is known by its fingerprint, so equal sets are one node and copies are never compared. Each signature has a leader,
and from here on a node is in the groups of its signatures' leaders, with how many it shares: two nodes that share
signatures share as many by their leaders, and a family of near copies, whose signatures mostly have one leader, is a few
groups instead of one for each signature. Nodes first try the leader they share most with, then, in PIVOTS rounds, one that
a hash picks in each group that still has several components. Groups that lie in one component by then are done. Of the others, large groups are compared in
blocks of texts (which are shorter than their shingles' hashes), but never within a component, and a pair of blocks
returns a forest over components, not its links. What pairs across components remain are verified one by one.
That finds the same components as all links would.

Nulls and texts without words: no shingles, linked with nothing. Repeated rows share their node. A null doc_id
takes part, and is never a component's smallest. A very long text is a slice and a batch of its own. Further columns of
any name do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import by_bucket, mix, pack, shingle_sets, slices, unpack
from .components import components
from .shared import forget, partitions, stored, texts

#: Shingles that so many sets have are indexed by pairs, or by triples.
FREQUENT = 1024
VERY_FREQUENT = 1 << 20
#: Groups of a signature from this size on are verified in blocks of BLOCK sets, which emit links only.
LARGE = 64
BLOCK = 512
#: Sets smaller than this index frequent shingles singly too: combinations could not give the credit.
SMALL = 72
#: A prefix is longer by one part in so many than it must be; in return candidates must share that many signatures.
EXTRA = 4
#: Rounds in which each group that isn't one component yet tries a member picked by a hash.
PIVOTS = 3
#: The rounds end when one finds fewer links than one in so many of the nodes in question.
WORTH = 10
BLOOM_BITS = 1 << 26
_SALT = np.uint64(0x5851F42D4C957F2D)


def node_of(tokens: np.ndarray) -> int:
    """Fingerprint of a set, as a signed 64-bit value."""
    x = np.add.reduce(mix(tokens ^ _SALT), dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def nodes(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, node (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                sets = [(len(s), node_of(s) if len(s) else None) for s in shingle_sets(data, offsets, n)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64())], ["doc_id", "mark", "n_shingles", "node"])

    return docs.withColumn("mark", F.xxhash64("text")).mapInArrow(run, "doc_id long, mark long, n_shingles long, node long")


class Scheme:
    """Size schemes, and what a set of n shingles is indexed by."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.frequent, self.very_frequent, self.small = FREQUENT, VERY_FREQUENT, SMALL
        self.bounds = [1]
        while self.bounds[-1] < 1 << 40:
            self.bounds.append(-(-self.bounds[-1] * den // num))

    def missing(self, n: int) -> int:
        """How many of n shingles a linked set may lack."""
        return n - -(-n * self.num // self.den)

    def shared(self, n: int) -> int:
        """How many signatures a set of n shingles has in common with any that it links with (of the smaller such number of both)."""
        return 1 + self.missing(n) // EXTRA

    def shared_sql(self, n: Column) -> Column:
        return 1 + F.floor((n - F.floor((n * self.num + self.den - 1) / self.den)) / EXTRA)

    def may_link(self, n: np.ndarray, common: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether a set of n shingles, of which others have so many, can link with one of the other size: what both share is
        at least t / (1 + t) of their sizes together."""
        return (self.num + self.den) * common >= self.num * (n + other)

    def signatures(self, n: int, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """keys: what of the set other sets have too, times: how many sets have it, both in order of (times, key)."""
        need = self.missing(n) + self.shared(n) - (n - len(keys))
        if len(keys) > 1:
            own = np.concatenate(([True], keys[1:] != keys[:-1]))
            keys, times = keys[own], times[own]
        rare = int(np.searchsorted(times, self.frequent))
        if need <= 0:
            return keys[:0]
        if rare >= need:
            return keys[:need]
        own = int(np.searchsorted(self.bounds, n, "right")) - 1
        rest = list(zip(np.where(times[rare:] < self.very_frequent, 2, 3).tolist(), keys[rare:].tolist(), strict=True))
        out: list[int] = []
        for scheme in (own, own + 1):
            if self.bounds[scheme] < self.small:
                out += [t for _, t in rest[: need - rare]]
                continue
            share = self.missing(self.bounds[scheme]) + 1
            groups: dict[tuple[int, int], list[int]] = defaultdict(list)
            credit = rare
            for k, t in rest:
                group = groups[k, (t >> 7) % max(1, share * 5 // 6 if k == 2 else share // 2)]
                group.append(t)
                credit += len(group) >= k
                if credit >= need:
                    break
            combined = [c for (k, _), group in groups.items() for c in combinations(group, k)]
            for k in {len(c) for c in combined}:
                got = np.array([c for c in combined if len(c) == k], np.uint64)
                code = np.full(len(got), scheme, np.uint64) + _SALT
                for j in range(k):
                    code = mix(code ^ got[:, j])
                out += code.tolist()
        return np.concatenate((keys[:rare], np.array(out, np.uint64)))


def _owned(payloads: list[bytes], *kinds: type) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Distinct (node, n) of packed rows, each entry's place among them, and the further columns in parts. A payload is nodes, sizes, places, ..."""
    got = [unpack(p, np.int64, np.uint32, np.uint32, *kinds) for p in payloads]
    node, size = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    base = np.concatenate(([0], np.cumsum([len(g[0]) for g in got])))[:-1]
    own, first, at = np.unique(node, return_index=True, return_inverse=True)
    return np.stack((own, size[first].astype(np.int64)), 1), at[np.concatenate([g[2].astype(np.int64) + b for g, b in zip(got, base, strict=True)])], [[g[i] for g in got] for i in range(3, 3 + len(kinds))]


def _packed(nodes_: np.ndarray, places: np.ndarray, *columns: np.ndarray) -> bytes:
    who, at = np.unique(places, return_inverse=True)
    return pack(nodes_[who, 0], nodes_[who, 1].astype(np.uint32), at.astype(np.uint32), *columns)


#: A batch: its name, and nodes and sizes where they travel.
BATCH = (np.int64, np.int64, np.uint32)


def _dealt(bucket: np.ndarray, count: int, nodes_: np.ndarray, places: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    order, first = by_bucket(bucket, count)
    full = [b for b in range(count) if first[b] < first[b + 1]]
    payloads = []
    for b in full:
        rows = order[first[b] : first[b + 1]]
        payloads.append(_packed(nodes_, places[rows], *(c[rows] for c in columns)))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def shared_shingles(docs: DataFrame, n: int = 5) -> DataFrame:
    """bucket, payload: for each batch of sets, dealt out by batch, the shingles that other sets have too and how many have them.

    A shingle's key is its bucket and 32 more bits of its hash. Shingles that meet in a key only make candidates. A batch
    is known by its task and number (tasks may begin with equal sets); its nodes and sizes travel once. Equal sets count once in a task, so an often
    copied text seems shared by some at least: that costs an index entry, not a link.
    """
    count = partitions(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list[tuple[int, int]] = []
        seen: set[int] = set()
        task, number = TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            tokens, places = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint32), [len(h) for h in held])
            bucket = (tokens >> np.uint64(32)) % np.uint64(count)
            first = np.concatenate(([0], np.cumsum(np.bincount(bucket.astype(np.int64), minlength=count))))
            order = np.argsort((bucket << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF)))
            tokens, places = tokens[order].astype(np.uint32), places[order]
            nodes_ = np.array(ids, np.int64)
            name = mix(np.array([(task << 32) + number], np.uint64)).view(np.int64)
            home = int(name[0]) % count
            payloads = []
            for b in range(count):
                own, part = nodes_[: len(nodes_) if b == home else 0], tokens[first[b] : first[b + 1]]
                payloads.append(pack(name, own[:, 0], own[:, 1].astype(np.uint32), places[first[b] : first[b + 1]], np.diff(part, prepend=np.uint32(0)).astype(np.uint32)))
            return pa.RecordBatch.from_arrays([pa.array(range(count), pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

        size = 0
        for batch in batches:
            for _, data, offsets in slices(batch):
                for s in shingle_sets(data, offsets, n):
                    if len(s) and (node := node_of(s)) not in seen:  # equal sets of a task travel once
                        seen.add(node)
                        held.append(s)
                        ids.append((node, len(s)))
                        size += len(s)
                if size > 1_500_000:
                    yield out()
                    held, ids, size, number = [], [], 0, number + 1
        if size:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        got = [unpack(p, *BATCH, np.uint32, np.uint32) for p in table.column("payload").to_pylist()]
        ends = np.cumsum([len(g[3]) for g in got])
        keys = np.concatenate([np.cumsum(g[4], dtype=np.uint32) for g in got])
        _, group, times = np.unique(keys, return_inverse=True, return_counts=True)
        times = times[group].astype(np.uint32)
        mine = table.column("bucket")[0].as_py()
        to, payloads = [], []
        for g, low, high in zip(got, np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
            keep = np.flatnonzero(times[low:high] > 1)
            if len(keep) or len(g[1]):
                to.append(int(g[0][0]) % count)
                key = keys[low:high][keep]
                payloads.append(pack(*g[:3], np.full(int(len(keep) > 0), mine, np.uint32), g[3][keep], np.diff(key, prepend=np.uint32(0)).astype(np.uint32), times[low:high][keep]))
        return pa.table({"bucket": pa.array(to, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    rows = docs.mapInArrow(gather, "bucket int, payload binary")
    return rows.groupBy("bucket").applyInArrow(meet, "bucket int, payload binary")


def shared_signatures(shingles: DataFrame, scheme: Scheme) -> DataFrame:
    """sig, node, n, common, leader, size (of the group): signatures that at least two nodes have which may link. common: how many shingles of the
    node other sets have too. leader: of the group, the node with the largest such part (an original rather than an edited copy)."""
    count = partitions(shingles.sparkSession)

    def index(table: pa.Table) -> pa.Table:
        got = [unpack(p, *BATCH, np.uint32, np.uint32, np.uint32, np.uint32) for p in table.column("payload").to_pylist()]
        start, total = {}, 0
        for g in got:
            if len(g[1]):
                start[int(g[0][0])] = total
                total += len(g[1])
        nodes_ = np.stack((np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got]).astype(np.int64)), 1)
        places = np.concatenate([g[4].astype(np.int64) + start[int(g[0][0])] for g in got])
        key = np.concatenate([np.cumsum(g[5], dtype=np.uint32).astype(np.uint64) | np.uint64(int(g[3][0]) << 32 if len(g[3]) else 0) for g in got])
        times = np.concatenate([g[6] for g in got])
        order = np.lexsort((key, times, places))
        key, times, places = key[order], times[order], places[order]
        first = np.searchsorted(places, np.arange(len(nodes_) + 1))
        sigs, owner = [], []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            got = scheme.signatures(int(nodes_[i, 1]), key[a:b], times[a:b])
            if len(got):
                sigs.append(np.unique(got))
                owner.append(np.full(len(sigs[-1]), i))
        if not sigs:
            return pa.table({"bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        sig, place = np.concatenate(sigs), np.concatenate(owner)
        common = np.diff(first).astype(np.uint32)
        return pa.Table.from_batches([_dealt((mix(sig) % np.uint64(count)).astype(np.int64), count, nodes_, place, sig, common[place])])

    def meet(table: pa.Table) -> pa.Table:
        nodes_, place, parts = _owned(table.column("payload").to_pylist(), np.uint64, np.uint32)
        sig, held = map(np.concatenate, parts)
        common = np.zeros(len(nodes_), np.int64)
        np.maximum.at(common, place, held)
        size = nodes_[:, 1]
        order = np.lexsort((place, -common[place] / size[place], sig))
        sig, place = sig[order], place[order]
        keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (place[1:] != place[:-1])))  # a set that two tasks have
        for _ in range(3):  # what goes may leave others without a partner
            sig, place = sig[keep], place[keep]
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(starts, len(sig)))
            smallest = np.repeat(np.minimum.reduceat(size[place], starts), lengths) if len(sig) else size[place]
            keep = (np.repeat(lengths, lengths) > 1) & scheme.may_link(size[place], common[place], np.maximum(smallest, -(-size[place] * scheme.num // scheme.den)))
        leader = np.repeat(nodes_[place[starts], 0], lengths)
        return pa.table({"sig": sig.view(np.int64), "node": nodes_[place, 0], "n": size[place], "common": common[place], "leader": leader, "size": np.repeat(lengths, lengths)})

    return shingles.groupBy("bucket").applyInArrow(index, "bucket int, payload binary").groupBy("bucket").applyInArrow(meet, "sig long, node long, n long, common long, leader long, size long")


def _filled(bits: DataFrame) -> np.ndarray:
    """A Bloom filter of BLOOM_BITS from places that count from 1: BLOOM_BITS / 32768 rows at most, of 4 KB, come to the driver."""
    rows = bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def texts_of(docs: DataFrame, wanted: DataFrame, n: int = 5) -> DataFrame:
    """node, text of the wanted nodes. A Bloom filter of fixed size keeps most other texts out of the shuffle; the join is exact."""
    spark = docs.sparkSession
    bloom = _filled(wanted.select((F.pmod("node", F.lit(BLOOM_BITS)) + 1).alias("bit")))
    sent = spark.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, seen = sent.value, set()
        for batch in batches:
            for part, data, offsets in slices(batch):
                ids, at = [], []
                for i, s in enumerate(shingle_sets(data, offsets, n)):
                    if len(s):
                        node = node_of(s)
                        bit = node % BLOOM_BITS + 1
                        if node not in seen and _has(bloom, bit):
                            seen.add(node)
                            ids.append(node)
                            at.append(i)
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), part.column("text").take(pa.array(at))], ["node", "text"])

    got = docs.mapInArrow(run, "node long, text string")
    return got.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _has(bloom: np.ndarray, bit: int) -> bool:
    """As bitmap_bucket_number() and bitmap_bit_position() place a positive value."""
    return bool(bloom[(bit - 1) >> 3] & (1 << ((bit - 1) & 7)))


def verified(pairs: DataFrame, known: DataFrame, num: int, den: int, n: int = 5) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                sides = [[s for p, data, offsets in slices(part, side) for s in shingle_sets(data, offsets, n)] for side in ("text_a", "text_b")]
                keep = []
                for x, y in zip(*sides, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(known.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(known.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Of links between places a and b as many as join the same components, in order."""
    _, first = np.unique(np.stack((np.minimum(part[a], part[b]), np.maximum(part[a], part[b])), 1), axis=0, return_index=True)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    keep = []
    for i, x, y in zip(first.tolist(), part[a[first]].tolist(), part[b[first]].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(i)
    return np.array(keep, np.int64)


def block_links(groups: DataFrame, known: DataFrame, num: int, den: int, n: int = 5) -> DataFrame:
    """Links (a, b) that join the components within each leader's group as all its links do. A task has two blocks' texts at a
    time; a component of BLOCK members or more has blocks of its own, which are not compared with one another."""

    def compare(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        sets = [s for _, data, offsets in slices(batch) for s in shingle_sets(data, offsets, n)]
        side, node, part = (batch.column(c).to_numpy() for c in ("side", "node", "component"))
        own = batch.column("low")[0].as_py() == batch.column("high")[0].as_py()
        rows, columns = np.flatnonzero(side == 0), np.flatnonzero(side == 0 if own else side == 1)
        if not len(rows) or not len(columns):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        left, right = (np.concatenate([sets[i] for i in x]) for x in (rows, columns))
        vocabulary = np.intersect1d(left, right)
        counts = np.zeros((len(rows), len(columns)), np.float32)
        for low in range(0, len(vocabulary), 8192):
            words = vocabulary[low : low + 8192]
            matrices = []
            for x in (rows, columns):
                m = np.zeros((len(x), len(words)), np.float32)
                for k, i in enumerate(x):
                    at = np.minimum(np.searchsorted(words, sets[i]), len(words) - 1)
                    m[k, at[words[at] == sets[i]]] = 1
                matrices.append(m)
            counts += matrices[0] @ matrices[1].T
        size = np.array([len(s) for s in sets], np.int64)
        both = np.rint(counts).astype(np.int64)
        hit = (den * both >= num * (size[rows][:, None] + size[columns][None, :] - both)) & (part[rows][:, None] != part[columns][None, :])
        a, b = np.nonzero(hit)
        a, b = rows[a], columns[b]
        keep = _forest(a, b, part)
        return pa.table({"a": node[a[keep]], "b": node[b[keep]]})

    parts = groups.groupBy("leader", "component").agg(F.count("*").alias("members"))
    loose = parts.where(F.col("members") < BLOCK).groupBy("leader").agg(F.sum("members").alias("loose"))
    whole = F.col("members") >= BLOCK
    among = lambda size: F.pmod(F.xxhash64("node"), F.ceil(size / BLOCK))
    block = F.struct(whole.alias("whole"), F.when(whole, F.col("component")).otherwise(0).alias("of"), F.when(whole, among(F.col("members"))).otherwise(among(F.col("loose"))).alias("number"))
    each = stored(groups.join(parts, ["leader", "component"]).join(loose, "leader", "left").select("leader", "node", "component", block.alias("block")), "blocked")
    blocks = each.select("leader", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "low").join(blocks.withColumnRenamed("block", "high"), "leader")
    pairs = pairs.where("low <= high and not (low.whole and high.whole and low.of = high.of)")
    sides = pairs.select("leader", F.col("low").alias("block"), "low", "high", F.lit(0).alias("side")).unionByName(pairs.where("low <> high").select("leader", F.col("high").alias("block"), "low", "high", F.lit(1).alias("side")))
    dealt = each.join(sides, ["leader", "block"]).join(known, "node")
    return dealt.groupBy("leader", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach). num / den is 0.75 or more."""
    return grouped(docs, num, den, n).drop("mark")


def grouped(docs: DataFrame, num: int = 75, den: int = 100, n: int = 5) -> DataFrame:
    """near_duplicates() with mark, the hash of each row's text."""
    spark = docs.sparkSession
    docs = texts(docs)
    scheme = Scheme(num, den)
    listed = stored(nodes(docs, n), "nodes")
    every = stored(shared_signatures(shared_shingles(docs, n), scheme), "signatures")
    least_n = F.floor((F.col("n") * num + den - 1) / den)
    able = every.groupBy("node", "n").count().where(F.col("count") >= scheme.shared_sql(least_n)).select("node", "n")
    index = stored(every.join(able.select("node"), "node", "left_semi"), "index")
    forget(every)
    led = stored(index.groupBy("leader", "node", "n", "common").agg(F.count("*").alias("shared")), "led")
    forget(index)
    fits = (F.col("n") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n") * num) & ((num + den) * F.least("common", "common_b") >= num * (F.col("n") + F.col("n_b")))
    enough = F.col("both") >= F.least(scheme.shared_sql(F.col("n")), scheme.shared_sql(F.col("n_b")))

    wanted = led.select("node", "n", "common").distinct()
    known = stored(texts_of(docs, wanted.select("node"), n), "texts")
    sized = wanted.select(F.col("node").alias("leader"), F.col("n").alias("n_b"), F.col("common").alias("common_b"))
    tried = led.where("node <> leader").withColumnRenamed("shared", "both").join(sized, "leader")
    first = tried.where(fits & enough).groupBy(F.col("node").alias("a")).agg(F.max_by("leader", F.struct("both", "leader")).alias("b"))
    links = stored(verified(first, known, num, den, n), "links")

    part = components(links)

    def joined(more: DataFrame) -> int:
        """Takes further links in; how many there are. part stays as it is: pairs across its components are all tried later on."""
        nonlocal links
        more = stored(more, "links")
        n = more.count()
        links = links.unionByName(more) if n else links
        return n

    def narrowed(rows: DataFrame) -> DataFrame:
        """rows of the groups that have several components by now."""
        placed = rows.select("leader", "node", "n", "common", "shared").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = placed.groupBy("leader").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("leader")
        out = stored(placed.join(several, "leader", "left_semi"), "open")
        forget(rows)
        return out

    open_ = narrowed(led)
    new = 0
    for number in range(PIVOTS):
        left_ = open_.select("node").distinct().count()
        pivot = F.min_by(F.struct("node", "n", "common", "component", "shared"), F.xxhash64("node", F.lit(number)))
        tried = open_.join(open_.groupBy("leader").agg(pivot.alias("pivot")), "leader").where("component <> pivot.component")
        tried = tried.groupBy("node", "n", "common", F.col("pivot.node").alias("node_b"), F.col("pivot.n").alias("n_b"), F.col("pivot.common").alias("common_b")).agg(F.sum(F.least("shared", "pivot.shared")).alias("both"))
        best = tried.where(fits & enough).groupBy(F.col("node").alias("a")).agg(F.max_by("node_b", F.struct("both", "node_b")).alias("b"))
        found = joined(verified(best, known, num, den, n)) if left_ else 0
        new += found
        if found * WORTH < left_ or not left_:
            break
        part, new = components(links), 0
        open_ = narrowed(open_)

    if not open_.isEmpty():
        held = open_.groupBy("leader").agg(F.count("*").alias("size")).where(F.col("size") >= LARGE)
        homes = stored(open_.join(held, "leader").groupBy("node").agg(F.max_by("leader", F.struct("size", "leader")).alias("home")), "homes")
        in_blocks = stored(open_.join(homes.select(F.col("home").alias("leader")).distinct(), "leader", "left_semi"), "blocks")
        member = in_blocks.groupBy("node").agg(F.collect_set("leader").alias("met"))
        if not in_blocks.isEmpty():
            new += joined(block_links(in_blocks, known, num, den, n))
        rest = stored(open_.join(member, "node", "left"), "rest")
        left, right = (rest.select("leader", *(F.col(c).alias(f"{c}{end}") for c in ("node", "n", "common", "shared", "component", "met"))) for end in ("", "_b"))
        apart = (F.col("component") < F.col("component_b")) & ~F.coalesce(F.arrays_overlap("met", "met_b"), F.lit(False))  # else compared in a block
        both = left.join(right, (left["leader"] == right["leader"]) & fits & apart)
        pairs = both.groupBy(F.col("node").alias("a"), F.col("node_b").alias("b"), "n", "n_b").agg(F.sum(F.least("shared", "shared_b")).alias("both")).where(enough).select("a", "b")
        new += joined(verified(pairs, known, num, den, n))
        for table in (homes, in_blocks, rest):
            forget(table)
    part = components(links) if new else part
    forget(known)
    forget(open_)

    placed = listed.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_id = stored(placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    spread = placed.join(least_id, "component", "left")
    return spread.select("doc_id", "mark", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, num: int = 75, den: int = 100, n: int = 5) -> DataFrame:
    """The rows of docs, all columns as they are, but those whose doc_id isn't their group's smallest. Rows without words
    or doc_id stay, and so do repeated rows of a doc_id that stays. Only texts that a Bloom filter can't tell from dropped ones are shuffled."""
    found = stored(grouped(docs, num, den, n), "groups")
    drop = found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id", "mark").distinct()
    place = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BLOOM_BITS)) + 1
    sent = docs.sparkSession.sparkContext.broadcast(_filled(drop.select(place(F.col("doc_id"), F.col("mark")).alias("bit"))))
    id_, mark = docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))
    rows = docs.select(id_.alias("doc_id"), mark.alias("mark"), place(id_, mark).alias("bit"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))

    def part(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = batch.column("bit").to_numpy() - 1
                inside = (sent.value[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1
                yield batch.filter(pa.array(inside == hit))

        return rows.mapInArrow(run, rows.schema)

    kept = part(False).unionByName(part(True).join(drop, ["doc_id", "mark"], "left_anti").select(*rows.columns))
    return kept.select("row.*")
