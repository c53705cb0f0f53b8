"""Language-model scores by stupid backoff over word bigrams, counted on the corpus itself.

S(w | v) = c(v w) / c(v) if c(v w) reaches min_count, else alpha * c(w) / N. Each text is read as
<start> w1 ... wn <end>; <end> is predicted too and c(<start>) is the number of texts with words. A document's
score is the sum of log S over its n + 1 predictions.

Exploded bigrams (context, word, document, count) are dealt out by a hash of the context, so the counts of a
bigram and of its context meet the documents that use it. What has to back off goes on, dealt out by the
word, to the word counts that the first step found. Sums per document are added up at the end. Words
that make up more than HOT of the text have their exact counts broadcast (1 / HOT words at most); as
contexts they are dealt out by the whole bigram, so no word's bigrams lie in one task.

Rows travel packed: sorted contexts as gaps, words as places in a sorted list of 64-bit hashes, documents as places in
a short list. A word is its 64-bit hash: at a billion distinct words the chance that any two are one is 0.03.

The order is 2. A third word to each row would bring what is exchanged from about 3 to over 4 times the input.

Nulls and texts without words have no predictions: score 0 and a null average. Repeated rows count as often
as they occur and get equal scores. A null doc_id keeps its row. A very long text is worked on by itself, whole.
Further columns of any name are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import _STEP, by_bucket, mix, pack, slices, spans_hash, unpack, word_bounds
from .shared import marked, partitions, stored

ALPHA = 0.4
MIN_COUNT = 2
HOT = 1 / 2000
START, END = mix(np.array([0x3C73746172743E, 0x3C656E643E], np.uint64))
CHUNK = 4 << 20
NO_ID = -(1 << 63)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's 64-bit hash; the number of words before each text."""
    starts, ends, first = word_bounds(data, offsets)
    return spans_hash(data, starts, ends), first


def hot_words(docs: DataFrame) -> dict[int, int]:
    """Exact counts of <start>, <end> and the words with a share of HOT or more."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch, limit=CHUNK):
                word, n = np.unique(_words(data, offsets)[0], return_counts=True)
                keep = n >= n.sum() * HOT / 2
                yield pa.RecordBatch.from_arrays([pa.array([*word[keep].view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n[keep], n.sum()))], ["word", "n"])

    rows = docs.select("text").mapInArrow(often, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    rows = stored(rows, "often")
    total = (rows.where("word is null").agg(F.sum("n")).first()[0]) or 0
    listed = np.sort(np.array([r["word"] for r in rows.where(F.col("word").isNotNull() & (F.col("n") >= total * HOT / 2)).collect()], np.int64).view(np.uint64))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, texts_ = np.zeros(len(listed) + 1, np.int64), 0
        for batch in batches:
            for _, data, offsets in slices(batch):
                word, first = _words(data, offsets)
                texts_ += int((np.diff(first) > 0).sum())
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, word), len(listed) - 1)
                    n += np.bincount(at[listed[at] == word], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(listed, (START, END)).view(np.int64)), pa.array([*n[:-1].tolist(), texts_, texts_], pa.int64())], ["word", "n"])

    return {r["word"]: r["n"] for r in docs.select("text").mapInArrow(exact, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


class _Hot:
    def __init__(self, counts: dict[int, int]) -> None:
        words = np.array(list(counts), np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words, self.counts = words[order], np.array(list(counts.values()), np.int64)[order]

    def of(self, words: np.ndarray) -> np.ndarray:
        """Counts of hot words, 0 for others."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0)


def _listed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(values, return_inverse=True)


def _pairs(docs: DataFrame, counts: dict[int, int]) -> DataFrame:
    """bucket, payload: the exploded bigrams of each task, one entry for a document's equal ones."""
    count = partitions(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _Hot(counts)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        size = docs_ = 0

        def out() -> pa.RecordBatch:
            context, word, doc = (np.concatenate([h[i] for h in held]) for i in range(3))
            id_, mark = np.concatenate(ids), np.concatenate(marks)
            pair = mix(context * _STEP + word)
            _, at, n = np.unique(mix(pair ^ mix(doc.astype(np.uint64))), return_index=True, return_counts=True)
            order = np.argsort(at)
            at, n = at[order], n[order]
            context, word, doc, pair = context[at], word[at], doc[at], pair[at]
            bucket = (np.where(hot.of(context) > 0, pair, mix(context)) % np.uint64(count)).astype(np.uint64)
            order = np.argsort(context, kind="stable")
            by, first = by_bucket(bucket[order].astype(np.int64), count)
            order = order[by]
            full, payloads = [], []
            for b in range(count):
                rows = order[first[b] : first[b + 1]]
                if len(rows):
                    own, runs = np.unique(context[rows], return_counts=True)
                    who, place = _listed(doc[rows])
                    words, at = _listed(word[rows])
                    full.append(b)
                    payloads.append(pack(np.diff(own, prepend=np.uint64(0)), runs.astype(np.uint32), np.diff(words, prepend=np.uint64(0)), at.astype(np.uint32), place.astype(np.uint32), n[rows].astype(np.uint32), id_[who], mark[who]))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

        for batch in batches:
            for part, data, offsets in slices(batch):
                word, first = _words(data, offsets)
                n = np.diff(first)
                filled = np.flatnonzero(n)
                doc = np.repeat(np.arange(len(n)), np.where(n > 0, n + 1, 0))
                last = np.cumsum(n[filled] + 1) - 1
                next_ = np.empty(len(doc), np.uint64)
                inner = np.ones(len(doc), bool)
                inner[last] = False
                next_[inner], next_[last] = word, END
                context = np.empty(len(doc), np.uint64)
                head = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
                inner[:] = True
                inner[head] = False
                context[inner], context[head] = word, START
                held.append((context, next_, doc + docs_))
                ids.append(part.column("doc_id").fill_null(NO_ID).to_numpy())
                marks.append(part.column("mark").to_numpy())
                docs_ += part.num_rows
                size += len(data)
                if size > CHUNK:
                    if sum(len(h[0]) for h in held):
                        yield out()
                    held, ids, marks, size, docs_ = [], [], [], 0, 0
        if sum(len(h[0]) for h in held):
            yield out()

    return docs.mapInArrow(run, "bucket int, payload binary")


def _per_document(id_: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (id, mark), and where each row's stands."""
    both, at = np.unique(np.stack((id_, mark), 1), axis=0, return_inverse=True)
    return both[:, 0], both[:, 1], at.ravel()


def _resolved(pairs: DataFrame, counts: dict[int, int], alpha: float, min_count: int) -> DataFrame:
    """bucket, payload: sums of what was found, the words that others back off to, and word counts, dealt out by word."""
    count = partitions(pairs.sparkSession)

    def meet(table: pa.Table) -> pa.Table:
        hot = _Hot(counts)
        got = [unpack(p, np.uint64, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32, np.int64, np.int64) for p in table.column("payload").to_pylist()]
        context = np.concatenate([np.repeat(np.cumsum(g[0], dtype=np.uint64), g[1]) for g in got])
        word = np.concatenate([np.cumsum(g[2], dtype=np.uint64)[g[3]] for g in got])
        n = np.concatenate([g[5] for g in got]).astype(np.int64)
        base = np.concatenate(([0], np.cumsum([len(g[6]) for g in got])))[:-1]
        id_, mark, at = _per_document(np.concatenate([g[6] for g in got]), np.concatenate([g[7] for g in got]))
        doc = at[np.concatenate([g[4].astype(np.int64) + b for g, b in zip(got, base, strict=True)])]
        del got
        _, pair = _listed(mix(context * _STEP + word))
        together = np.bincount(pair, n)[pair]
        own, of = _listed(context)
        known = hot.of(own)
        alone = np.where(known > 0, known, np.bincount(of, n))
        found = together >= min_count
        gain = np.where(found, n * np.log(together / alone[of]), 0.0)
        direct = ~found & (hot.of(word) > 0)
        gain[direct] = n[direct] * np.log(alpha * hot.of(word[direct]))
        columns = [np.bincount(doc, x, minlength=len(id_)) for x in (gain, n, np.where(found, 0, n), np.where(context == START, n, 0))]
        rest = np.flatnonzero(~found & ~direct)
        bucket = (mix(word[rest]) % np.uint64(count)).astype(np.int64)
        order, first = by_bucket(bucket, count)
        plain = known == 0
        table_bucket = (mix(own[plain]) % np.uint64(count)).astype(np.int64)
        table_order, table_first = by_bucket(table_bucket, count)
        table_word, table_n = own[plain], alone[plain].astype(np.int64)
        mine = table.column("bucket")[0].as_py()
        full, payloads = [], []
        for b in range(count):
            rows, words = rest[order[first[b] : first[b + 1]]], table_order[table_first[b] : table_first[b + 1]]
            sums = np.arange(len(id_) if b == mine else 0)
            if len(rows) or len(words) or len(sums):
                rows = rows[np.argsort(word[rows], kind="stable")]
                who, place = _listed(doc[rows])
                full.append(b)
                payloads.append(pack(np.diff(word[rows], prepend=np.uint64(0)), place.astype(np.uint32), n[rows].astype(np.uint32), id_[who], mark[who], np.diff(table_word[words], prepend=np.uint64(0)), table_n[words], id_[sums], mark[sums], *(c[sums].astype(np.float64) for c in columns)))
        return pa.table({"bucket": pa.array(full, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    return pairs.groupBy("bucket").applyInArrow(meet, "bucket int, payload binary")


def _summed(parts: DataFrame, alpha: float) -> DataFrame:
    """id, mark and sums of each document; what a task adds up travels packed, dealt out by document."""
    count = partitions(parts.sparkSession)
    kinds = (np.uint64, np.uint32, np.uint32, np.int64, np.int64, np.uint64, np.int64, np.int64, np.int64, *(np.float64,) * 4)

    def add(table: pa.Table) -> pa.Table:
        got = [unpack(p, *kinds) for p in table.column("payload").to_pylist()]
        known = np.concatenate([np.cumsum(g[5], dtype=np.uint64) for g in got])
        times = np.concatenate([g[6] for g in got])
        order = np.argsort(known)
        known, times = known[order], times[order]
        word = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
        n = np.concatenate([g[2] for g in got]).astype(float)
        base = np.concatenate(([0], np.cumsum([len(g[3]) for g in got])))[:-1]
        place = np.concatenate([g[1].astype(np.int64) + b for g, b in zip(got, base, strict=True)])
        gain = n * np.log(alpha * times[np.searchsorted(known, word)]) if len(word) else n
        more = np.bincount(place, gain, minlength=sum(len(g[3]) for g in got))
        zero = np.zeros(len(more))
        columns = [np.concatenate([np.concatenate([g[i] for g in got]), now]) for i, now in zip(range(9, 13), (more, zero, zero, zero), strict=True)]
        id_, mark, at = _per_document(np.concatenate([*(g[7] for g in got), *(g[3] for g in got)]), np.concatenate([*(g[8] for g in got), *(g[4] for g in got)]))
        sums = [np.bincount(at, c, minlength=len(id_)) for c in columns]
        order, first = by_bucket((mix(id_.view(np.uint64) ^ mix(mark.view(np.uint64))) % np.uint64(count)).astype(np.int64), count)
        full = [b for b in range(count) if first[b] < first[b + 1]]
        payloads = [pack(id_[rows], mark[rows], *(s[rows] for s in sums)) for rows in (order[first[b] : first[b + 1]] for b in full)]
        return pa.table({"bucket": pa.array(full, pa.int32()), "payload": pa.array(payloads, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        got = [unpack(p, np.int64, np.int64, *(np.float64,) * 4) for p in table.column("payload").to_pylist()]
        id_, mark, at = _per_document(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        return pa.table({"id": id_, "mark": mark, **{name: np.bincount(at, np.concatenate([g[i] for g in got])) for i, name in enumerate(("gain", "n", "n_back", "n_rows"), 2)}})

    added = parts.groupBy("bucket").applyInArrow(add, "bucket int, payload binary")
    return added.groupBy("bucket").applyInArrow(total, "id long, mark long, gain double, n double, n_back double, n_rows double")


def scores(docs: DataFrame, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, n_predictions, n_backoff, log_score, log_score_mean for each document."""
    docs = marked(docs)
    counts = hot_words(docs)
    sums = stored(_summed(_resolved(_pairs(docs, counts), counts, alpha, min_count), alpha), "sums")
    total = sums.agg(F.sum("n")).first()[0]
    rows = docs.select("doc_id", "mark", F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).join(sums, ["id", "mark"], "left")
    whole = lambda c: F.coalesce(F.round(F.col(c) / F.col("n_rows")), F.lit(0)).cast("long")
    value = F.coalesce((F.col("gain") - F.col("n_back") * F.lit(float(np.log(total or 1)))) / F.col("n_rows"), F.lit(0.0))
    rows = rows.select("doc_id", whole("n").alias("n_predictions"), whole("n_back").alias("n_backoff"), value.alias("value"))
    return rows.select("doc_id", "n_predictions", "n_backoff", F.round("value", 4).alias("log_score"), F.round(F.try_divide(F.col("value"), F.col("n_predictions")), 6).alias("log_score_mean"))


SQL = rf"""
    with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    p as (select doc_id, unnest(list_concat(['<start>'], w)) as v, unnest(list_concat(w, ['<end>'])) as w from t where len(w) > 0),
    c2 as (select v, w, count(*) as c from p group by all),
    c1 as (select v, count(*) as c from p group by all),
    u as (select w, count(*) as c from p group by all),
    s as (select doc_id, c2.c >= {MIN_COUNT} as found, case when c2.c >= {MIN_COUNT} then ln(c2.c / c1.c) else ln({ALPHA} * u.c / (select count(*) from p)) end as x
        from p join c2 using (v, w) join c1 using (v) join u on u.w = p.w),
    g as (select doc_id, count(*) as n, count(*) filter (not found) as b, sum(x) as x from s group by doc_id)
    select doc_id, coalesce(n, 0)::bigint as n_predictions, coalesce(b, 0)::bigint as n_backoff, round(coalesce(x, 0), 4) as log_score, round(x / n, 6) as log_score_mean
    from documents left join g using (doc_id)"""
