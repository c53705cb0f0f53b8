"""Hard negatives by the threshold algorithm over per-dimension sorted lists.

Anchors are a stated part of the rows. Each one's positives are the rows of its label with the highest integer inner
products; its negatives, for each positive, the best rows of other labels whose score lies in a window below
the positive's. Both searches go through blocks of candidates: within a block each dimension has a sorted list, read
from the top for anchors that are positive there and from the bottom for negative ones. The rows that come into sight at
a depth are looked up and scored in full. The threshold is what a row not yet seen could score at most, the sum
over dimensions of the anchor's component times the last value read. A search ends in a block once the threshold is
strictly below its kth score, or below the window; at the end of the lists otherwise. Anchors of a batch share what any of
them has read: more rows are scored than one anchor asks for, never fewer.

Rows travel packed. Candidates are dealt to blocks of BLOCK rows at most on average, anchors to blocks of ANCHORS,
and each pair of blocks is one task's group, so memory depends on neither the table nor a label or vector that
is very common. The work is anchors times candidates at worst: a stated query set against all rows.

Rows with a null label, vector, component or vec_id, or a component that isn't finite, take no part. Vectors of
different lengths count as zero where they end; an empty vector scores 0. Ties go to the smaller vec_id. Rows that share a
vec_id are rows of their own, each with its ranks; an anchor's own id is never its positive or negative. A score that doesn't fit a
long is an error. Further columns do no harm. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import pack, unpack
from .shared import partitions, stored

BLOCK = 1 << 14
ANCHORS = 1 << 13
BATCH = 1 << 10
COLUMNS = 1 << 11
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label (changed where vec_id is divisible by 7) and embedding of rows that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def top(group: np.ndarray, score: np.ndarray, id_: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each group: higher scores, then smaller ids; in order of group."""
    order = np.lexsort((id_, -score, group))
    new = np.append(True, np.diff(group[order]) != 0)[: len(order)]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    order = order[place < k]
    return group[order], score[order], id_[order]


class Lists:
    """A block's vectors with the sorted list of each dimension."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        n = len(vectors)
        order = np.argsort(-vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        self.rank = np.empty(order.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)

    def seen_at(self, anchors: np.ndarray) -> np.ndarray:
        """At which depth (from 1) each row comes into sight of one of the anchors, on the end of each list that its sign asks for."""
        n = len(self.vectors)
        far = np.full(n, n, np.int32)
        for j in range(self.vectors.shape[1]):
            if (anchors[:, j] > 0).any():
                np.minimum(far, self.rank[:, j], out=far)
            if (anchors[:, j] < 0).any():
                np.minimum(far, n - 1 - self.rank[:, j], out=far)
        return far + 1

    def threshold(self, anchors: np.ndarray, depth: int) -> np.ndarray:
        """What a row not seen at that depth can score at most."""
        exact = anchors.astype(np.float64) if anchors.dtype != object else anchors
        high, low = self.sorted[depth - 1], self.sorted[len(self.vectors) - depth]
        return np.maximum(exact, 0) @ high.astype(exact.dtype) + np.minimum(exact, 0) @ low.astype(exact.dtype)


def rounds(lists: Lists, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows in the order of sight, with the depth read so far (0 while a depth isn't through yet). Depths double."""
    n = len(lists.vectors)
    seen = lists.seen_at(anchors)
    order = np.argsort(seen, kind="stable")
    low, depth = 0, 1
    while low < n:
        depth = min(depth, n)
        high = n if depth == n else int(np.searchsorted(seen[order], depth, "right"))
        for at in range(low, high, COLUMNS):
            yield order[at : min(at + COLUMNS, high)], depth if at + COLUMNS >= high else 0
        if high == low:
            yield order[low:high], depth
        low, depth = high, depth * 2


def _kth(group: np.ndarray, score: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each group has k, and its kth score; groups are sorted."""
    full = np.bincount(group, minlength=n) >= k
    out = np.zeros(n, np.int64)
    last = np.searchsorted(group, np.arange(n), "right") - 1
    out[full] = score[last[full]]
    return full, out


def nearest(anchors: np.ndarray, own: np.ndarray, lists: Lists, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor, score, id) of the k best rows for each anchor, its own id left out."""
    n = len(anchors)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    full, kth = np.zeros(n, bool), np.zeros(n, np.int64)
    active = np.arange(n)
    for rows, depth in rounds(lists, anchors):
        if len(rows):
            score = anchors[active] @ lists.vectors[rows].T
            least = np.where(full[active], kth[active].astype(score.dtype), -np.inf)
            if len(rows) > k + 1:  # one more, as the anchor itself may be there
                some = np.sort(score, axis=1) if score.dtype == object else np.partition(score, len(rows) - k - 1, axis=1)
                least = np.maximum(least, some[:, len(rows) - k - 1])
            a, c = np.nonzero(score >= least[:, None])
            other = ids[rows[c]] != own[active[a]]
            a, c = a[other], c[other]
            best = top(np.concatenate((best[0], active[a])), np.concatenate((best[1], score[a, c].astype(np.int64))), np.concatenate((best[2], ids[rows[c]])), k)
            full, kth = _kth(best[0], best[1], n, k)
        if depth:
            active = active[~full[active] | (lists.threshold(anchors[active], depth) >= kth[active])]
            if not len(active):
                break
    return best


def within(anchors: np.ndarray, labels: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, lists: Lists, ids: np.ndarray, row_labels: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(anchor * windows + window, score, id) of the k best rows of other labels in each of an anchor's windows; low > high: no window."""
    n, w = low.shape
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    need = low.copy()  # the least score that still counts
    real = low <= high
    active = np.flatnonzero(real.any(axis=1))
    for rows, depth in rounds(lists, anchors[active]) if len(active) else ():
        if len(rows):
            score = anchors[active] @ lists.vectors[rows].T
            least = np.where(real, need, np.iinfo(np.int64).max).min(axis=1)[active].astype(score.dtype)
            most = np.where(real, high, np.iinfo(np.int64).min).max(axis=1)[active].astype(score.dtype)
            a, c = np.nonzero((score >= least[:, None]) & (score <= most[:, None]))
            who, row = active[a], rows[c]
            other = (row_labels[row] != labels[who]) & (ids[row] != own[who])
            who, row, value = who[other], row[other], score[a[other], c[other]].astype(np.int64)
            groups, scores, names = [best[0]], [best[1]], [best[2]]
            for i in range(w):
                fit = real[who, i] & (value >= need[who, i]) & (value <= high[who, i])
                groups.append(who[fit] * w + i)
                scores.append(value[fit])
                names.append(ids[row[fit]])
            best = top(np.concatenate(groups), np.concatenate(scores), np.concatenate(names), k)
            full, kth = _kth(best[0], best[1], n * w, k)
            need = np.where(full, kth, low.ravel()).reshape(n, w)
        if depth:
            bound = lists.threshold(anchors[active], depth)
            active = active[(real[active] & (bound[:, None] >= need[active])).any(axis=1)]
            if not len(active):
                break
    return best


def _number_type(bound: int) -> type:
    """Floats hold whole numbers up to a size exactly, so products and their sums stay exact below it; beyond, Python's own."""
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def _whole(vectors: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in vectors], object).reshape(vectors.shape) if kind is object else vectors.astype(kind)


def _packed(rows: DataFrame, dim: int, every: int, n_blocks: int, n_anchor_blocks: int, width: int) -> DataFrame:
    """side (0: candidates, 1: anchors), block, payload. A row's key is the task that read it and its number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at = 0
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            column = batch.column("embedding")
            sizes = column.value_lengths().to_numpy()
            vectors = np.zeros((len(ids), dim))
            row = np.repeat(np.arange(len(ids)), sizes)
            vectors[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            side, block, payload = [], [], []
            for low in range(0, len(ids), width):
                s = slice(low, low + width)
                mine = np.flatnonzero(ids[s] % every == 0) + low
                keys = (part << 33) + at + mine
                for kind, rows_, blocks in ((0, np.arange(low, min(low + width, len(ids))), n_blocks), (1, mine, n_anchor_blocks)):
                    if len(rows_):
                        side.append(kind)
                        block.append((part + (at + low) // width) % blocks)
                        payload.append(pack(keys if kind else np.zeros(0, np.int64), ids[rows_], labels[rows_], vectors[rows_].ravel()))
            at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(block, pa.int64()), pa.array(payload, pa.binary())], ["side", "block", "payload"])

    return rows.mapInArrow(run, "side int, block long, payload binary")


def _unpacked(payloads: pa.ChunkedArray, dim: int, kind: type) -> tuple[np.ndarray, ...]:
    """keys, ids, labels and vectors of all of a block's payloads."""
    parts = [unpack(p, np.int64, np.int64, np.int64, np.float64) for p in payloads.to_pylist()]
    keys, ids, labels, flat = (np.concatenate([p[i] for p in parts]) for i in range(4))
    return keys, ids, labels, _whole(flat.reshape(-1, dim), kind)


def mined(rows: DataFrame, every: int = 100, k: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor (vec_id divisible by every) and each of its k positives, the first k rows of other labels whose score is low to high percent of the positive's."""
    spark = rows.sparkSession
    rows = usable(rows)
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors"), F.max(F.size("embedding")).alias("dim"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))).alias("most")).first()
    if not size["anchors"]:
        return spark.createDataFrame([], OUT)
    dim, most = max(size["dim"], 1), int(256 * (size["most"] or 0.0)) + 1
    kind = _number_type(dim * most * most)
    n_blocks = max(-(-size["n"] // BLOCK), min(2 * partitions(spark), -(-size["n"] // 512)))
    n_anchor_blocks = -(-size["anchors"] // ANCHORS)
    packed = stored(_packed(rows, dim, every, n_blocks, n_anchor_blocks, -(-size["n"] // n_blocks)), "vectors")
    candidates = packed.where("side = 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_anchor_blocks - 1).cast("long"))).alias("a"), F.col("block").alias("c"), F.col("payload").alias("rows"))
    anchors = packed.where("side = 1").select(F.col("block").alias("a"), F.lit(0).alias("kind"), "payload")

    def cells(sent: DataFrame) -> DataFrame:
        return sent.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("c"), "kind", "payload")

    def positives(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 5), np.int64)]
        if left.num_rows and right.num_rows:
            _, ids, labels, vectors = _unpacked(left.column("rows"), dim, kind)
            keys, own, own_labels, own_vectors = _unpacked(right.column("payload"), dim, kind)
            for label in np.intersect1d(labels, own_labels).tolist():
                there, here = np.flatnonzero(labels == label), np.flatnonzero(own_labels == label)
                lists = Lists(vectors[there])
                for at in range(0, len(here), BATCH):
                    mine = here[at : at + BATCH]
                    a, score, id_ = nearest(own_vectors[mine], own[mine], lists, ids[there], k)
                    out.append(np.stack((np.full(len(a), key[0].as_py()), keys[mine[a]], own[mine[a]], id_, score), 1))
        every_ = np.concatenate(out)
        return pa.table({n: every_[:, i] for i, n in enumerate(("a", "key", "anchor_id", "positive_id", "score"))})

    local = candidates.groupBy("a", "c").cogroup(cells(anchors).groupBy("a", "c")).applyInArrow(positives, "a long, key long, anchor_id long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "positive_id"))
    first = stored(local.withColumn("place", place).where(F.col("place") <= k), "positives")

    def send(table: pa.Table) -> pa.Table:
        """All positives of a block of anchors, k for each."""
        columns = [table.column(c).to_numpy().astype(np.int64) for c in ("key", "place", "positive_id", "score")]
        return pa.table({"a": table.column("a")[:1], "kind": pa.array([1], pa.int32()), "payload": pa.array([pack(*columns)], pa.binary())})

    windows = first.groupBy("a").applyInArrow(send, "a long, kind int, payload binary")

    def negatives(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros((0, 7), np.int64)]
        kinds = right.column("kind").to_numpy() if right.num_rows else np.zeros(0)
        if left.num_rows and (kinds == 0).any() and (kinds == 1).any():
            _, ids, labels, vectors = _unpacked(left.column("rows"), dim, kind)
            keys, own, own_labels, own_vectors = _unpacked(right.column("payload").filter(pa.array(kinds == 0)), dim, kind)
            owner, rank, positive, score = unpack(right.column("payload").filter(pa.array(kinds == 1))[0].as_py(), *[np.int64] * 4)
            order = np.argsort(keys)
            at = order[np.searchsorted(keys[order], owner)]
            names, scores = (np.zeros((len(keys), k), np.int64) for _ in range(2))
            least, most_ = np.ones((len(keys), k), np.int64), np.zeros((len(keys), k), np.int64)
            names[at, rank - 1], scores[at, rank - 1] = positive, score
            exact = score.astype(object)  # low times a score may not fit a long
            least[at, rank - 1], most_[at, rank - 1] = -(-low * exact // 100), high * exact // 100
            lists = Lists(vectors)
            for start in range(0, len(keys), BATCH):
                s = slice(start, start + BATCH)
                group, value, id_ = within(own_vectors[s], own_labels[s], own[s], least[s], most_[s], lists, ids, labels, k)
                a, w = group // k + start, group % k
                out.append(np.stack((keys[a], own[a], w, names[a, w], scores[a, w], id_, value), 1))
        every_ = np.concatenate(out)
        return pa.table({n: every_[:, i] for i, n in enumerate(("key", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"))})

    sent = cells(anchors.unionByName(windows))
    found = candidates.groupBy("a", "c").cogroup(sent.groupBy("a", "c")).applyInArrow(negatives, "key long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
    with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_sum(list_transform(range(1, least(len(a.q), len(v.q)) + 1), lambda i: a.q[i] * v.q[i]))::bigint as score
        from v as a join v on a.vec_id % 100 = 0 and v.vec_id <> a.vec_id),
    p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same qualify place <= 5),
    n as (select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score, row_number() over (partition by anchor_id, place order by score desc, vec_id) as rank
        from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score qualify rank <= 5)
    select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n"""
