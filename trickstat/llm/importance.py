"""Importance resampling: documents drawn so that their hashed word runs look like those of a target.

A batch's texts are joined with a separator after each, one pass of one pattern finds the words of all, and a search
in the texts' offsets says which text a word is of, so that runs across texts are masked before they are counted.
Features are runs of 1 to 3 words. A run's checksum comes from those of its words, as CRC-32 is linear: the checksum of
what stands in front is moved on by the length of what follows, with tables for each power of two.

Corpus counts take one pass over all documents and come to the driver as BUCKETS numbers, as the target's do; the
gains of the buckets, as many, are broadcast. Ranks are given by a sort in ranges of (score, doc_id), so no task sees
all documents.

Null and empty texts have no words, weight 0, and are never drawn. A null doc_id counts as no digits in the hash and
stands before all others at ties. Repeated rows are documents of their own; among equal score and doc_id the one with
fewer features comes first. A very long text is a slice of its own. Further columns do no harm. An empty target makes
all of its counts 0. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keys import with_row_id
from .arrays import LOWER, slices
from .shared import stored, texts

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
SEPARATOR = 0x0A
#: What [^\x00-\x2F\x3A-\x60\x7B-\x7F] leaves of lower-cased UTF-8: digits, small letters, all bytes of other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xFF]+")
_BLANK = zlib.crc32(b" ")


def _moved_by_one() -> np.ndarray:
    """Row b, column v: the checksum v << 8b after one more zero byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    rest = [np.arange(256, dtype=np.uint32) << np.uint32(8 * b - 8) for b in (1, 2, 3)]
    return np.stack([table, *rest])


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_moves = [_moved_by_one()]


def moved(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Checksums as they count in front of n more bytes: crc32(a + b) = moved(crc32(a), len(b)) ^ crc32(b)."""
    crc, k = crc.copy(), 0
    while len(n) and int(n.max()) >> k:
        if k == len(_moves):
            _moves.append(np.stack([_apply(_moves[-1], row) for row in _moves[-1]]))
        some = np.flatnonzero((n >> k) & 1)
        crc[some] = _apply(_moves[k], crc[some])
        k += 1
    return crc


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Lower-cased texts with a separator after each, and where each begins."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.full(len(data) + n, SEPARATOR, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = LOWER[data]
    return out.tobytes(), offsets[:-1] + np.arange(n)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each feature, and the number of words of each text."""
    blob, begins = joined(data, offsets)
    words = np.fromiter((x for m in WORD.finditer(blob) for x in (m.start(), m.end(), zlib.crc32(m.group()))), np.int64).reshape(-1, 3)
    of = np.searchsorted(begins, words[:, 0], "right") - 1
    size, single = words[:, 1] - words[:, 0], words[:, 2].astype(np.uint32)
    run, at, crcs, texts_ = single, of, [single], [of]
    for n in range(2, LONGEST + 1):
        run = _apply(_moves[0], run[:-1]) ^ np.uint32(_BLANK)
        run = moved(run, size[n - 1 :]) ^ single[n - 1 :]
        whole = at[: len(run)] == of[n - 1 :]
        at = at[: len(run)]
        crcs.append(run[whole])
        texts_.append(at[whole])
    return (np.concatenate(crcs) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(texts_), np.bincount(of, minlength=len(offsets) - 1)


def counted(docs: DataFrame) -> DataFrame:
    """bucket, n: features of all texts. A task adds up its own, so what is shuffled depends on tasks and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in slices(batch):
                total += np.bincount(features(data, offsets)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over its share in docs; BUCKETS numbers."""
    own, other = (np.zeros(BUCKETS, np.int64) for _ in range(2))
    for df, into in ((docs, own), (target, other)):
        for row in counted(df).collect():  # BUCKETS rows at most
            into[row["bucket"]] = row["n"]
    s, t = own.tolist(), other.tolist()
    s_all, t_all = sum(s) + BUCKETS, sum(t) + BUCKETS
    return np.array([math.floor(1000 * math.log((b + 1) * s_all / ((a + 1) * t_all))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel variate), from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight (sum of gains), score (weight and noise)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                n = part.num_rows
                bucket, of, n_words = features(data, offsets)
                order = np.argsort(of, kind="stable")
                total = np.concatenate(([0], np.cumsum(sent.value[bucket[order]])))
                ends = np.cumsum(np.bincount(of, minlength=n))
                weight = total[ends] - total[np.concatenate(([0], ends[:-1]))]
                extra = np.array([noise(i, seed) for i in part.column("doc_id").to_pylist()], np.int64)
                out = (n_words, np.diff(np.concatenate(([0], ends))), weight, weight + extra)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in out)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document; rank is null unless it is drawn.

    Of the documents with least_words or more, so many percent (rounded down) with the highest scores are drawn, which is
    sampling without replacement in proportion to exp(weight / 1000)."""
    rows = stored(weighted(docs, gains(docs, target), seed), "weighted")
    rows = rows.withColumns({"_out": F.col("n_words") < least_words, "_low": -F.col("score")})
    n = rows.where(~F.col("_out")).count() * percent // 100
    ranked = with_row_id(rows, "_out", "_low", "doc_id", "n_features")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(~F.col("_out") & (F.col("row_id") <= n), F.col("row_id")).alias("rank"))


#: The checksum byte by byte, with its table made from the polynomial.
SQL = r"""
    with t as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
    d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
    b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    each as (select k, w, unnest(range(1, len(w) + 1)) as i from d union all select -1, w, unnest(range(1, len(w) + 1)) from b),
    f as (select k, w[i] as f from each union all select k, w[i] || ' ' || w[i + 1] from each where i + 1 <= len(w) union all select k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] from each where i + 2 <= len(w)),
    u as (select f, regexp_replace(hex(encode(f)), '(..)', '\1,', 'g')[:-2] as x from (select distinct f from f)),
    c as (select f, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(x, ','), lambda h: ('0x' || h)::bigint)), lambda c, h: xor(c >> 8, t[(xor(c, h) & 255) + 1])), 4294967295) % 10000 as bucket from u, t),
    n as (select k, bucket, count(*) as n from f join c using (f) group by 1, 2),
    g as (select bucket, coalesce(sum(n) filter (k >= 0), 0)::double as s, coalesce(sum(n) filter (k < 0), 0)::double as t from n group by 1),
    a as (select sum(s) as s_all, sum(t) as t_all from g),
    gain as (select bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::bigint as gain from g, a),
    w as (select k, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from n join gain using (bucket) where k >= 0 group by 1),
    r as (select k, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::varchar, ''))[:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
        from d left join w using (k)),
    o as (select k, row_number() over (order by score desc, doc_id nulls first, n_features) as rank from r where n_words >= 20)
    select doc_id, n_features, weight, score, case when rank <= 5 * (select count(*) from o) // 100 then rank end as rank from r left join o using (k)"""
