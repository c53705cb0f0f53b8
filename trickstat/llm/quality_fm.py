"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)), so pairwise interactions of all
features take time linear in the features a document has. Features come from the text alone.

The model is fitted on at most SAMPLE labelled documents (those of the smallest hash of doc_id) by mini-batches
with AdaGrad; those rows' features come to the driver, SAMPLE * DIMENSIONS numbers at most. All documents are scored.

Nulls and empty texts have only constant features and get a score too; labels that are null don't count; a
doc_id with two different labels gives two examples, one with two texts the smaller as one; a null doc_id is never held out and not
learnt from. Repeated rows get equal scores. A very long text is a slice of its own. Further columns do no harm.
Without any labels each score is 0.5. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, mix, slices, spans_hash, word_bounds
from .shared import texts

SAMPLE = 5_000
WORDS = 1 << 12
RANK = 8
EPOCHS = 12
#: Byte classes whose shares are features: controls, blank, digits, marks one by one, capitals, small letters, other bytes.
_KINDS = np.zeros(256, np.uint8)
for _i, _set in enumerate((range(33), range(48, 58), b"#", b"*", b"$", b"%&", b"|", b"<>", b"!?", b".,", b"-_", b":;'\"()", b"/\\@=+{}[]^~`", range(65, 91), range(97, 123))):
    _KINDS[list(_set)] = _i + 1
N_KINDS = 16
N_STATS = N_KINDS + 10
DIMENSIONS = WORDS + N_STATS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def featured(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (first entry of each text, one more than texts; dimension; value). Word values have length 1 in each text, statistics are about 0 to 1."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets)
    n_words = np.diff(first)
    of = np.repeat(np.arange(n), n_words)
    words = spans_hash(LOWER[data], starts, ends)
    cell = of * WORDS + (words % np.uint64(WORDS)).astype(np.int64)
    cells, count = np.unique(cell, return_counts=True)
    row, dim = cells // WORDS, cells % WORDS
    value = np.log1p(count.astype(float))
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value /= norm[row]

    size = np.diff(offsets)
    each = np.repeat(np.arange(n), size)
    kinds = np.bincount(each * N_KINDS + _KINDS[data], minlength=n * N_KINDS).reshape(n, N_KINDS) / np.maximum(size, 1)[:, None]
    one_each = np.unique(mix(words) ^ mix(of.astype(np.uint64)), return_index=True)[1]
    distinct = np.bincount(of[one_each], minlength=n)
    lines = np.bincount(each[data == 10], minlength=n) + 1
    many = np.maximum(n_words, 1)
    again = np.zeros(n)
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        again = np.bincount(of[1:][same], minlength=n) / many
    length = np.bincount(of, ends - starts, minlength=n) / many
    stats = np.column_stack((kinds, np.ones(n), np.log1p(n_words) / 10, np.log1p(size) / 12, distinct / many, again, np.minimum(length, 40) / 20, np.minimum(lines / many, 1), (n_words < 20).astype(float), (n_words == 0).astype(float), np.sqrt(kinds[:, 3:9].sum(1))))
    order = np.argsort(np.concatenate((row, np.repeat(np.arange(n), N_STATS))), kind="stable")
    dims = np.concatenate((dim, np.tile(np.arange(WORDS, DIMENSIONS), n)))[order]
    values = np.concatenate((value, stats.ravel()))[order]
    return np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n) + N_STATS))), dims, values


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)))
    return total[first[1:]] - total[first[:-1]]


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, seed: int = 7) -> None:
        self.bias, self.linear = 0.0, np.zeros(DIMENSIONS)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (DIMENSIONS, RANK))

    def margin(self, first: np.ndarray, dims: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = self.factors[dims] * values[:, None]
        sums = _sums(part, first)
        return self.bias + _sums(self.linear[dims] * values, first) + 0.5 * (sums**2 - _sums(part**2, first)).sum(1), sums

    def score(self, first: np.ndarray, dims: np.ndarray, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(first, dims, values)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 100, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
        """Logistic loss, by batches in an order that only the seed decides."""
        random = np.random.default_rng(seed)
        squares = [np.full(1, 1e-2), np.full(DIMENSIONS, 1e-2), np.full((DIMENSIONS, RANK), 1e-2)]
        for _ in range(epochs):
            order = random.permutation(len(rows))
            for low in range(0, len(order), batch):
                pick = order[low : low + batch]
                first = np.concatenate(([0], np.cumsum([len(rows[i][0]) for i in pick])))
                dims, values = (np.concatenate([rows[i][j] for i in pick]) for j in (0, 1))
                margin, sums = self.margin(first, dims, values)
                off = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[pick]) / len(pick)
                of = np.repeat(np.arange(len(pick)), np.diff(first))
                step = off[of] * values
                used, at = np.unique(dims, return_inverse=True)
                linear = np.bincount(at, step) + decay * self.linear[used]
                wide = step[:, None] * (sums[of] - self.factors[dims] * values[:, None])
                factors = np.column_stack([np.bincount(at, wide[:, f]) for f in range(RANK)]) + decay * self.factors[used]
                squares[0] += off.sum() ** 2
                squares[1][used] += linear**2
                squares[2][used] += factors**2
                self.bias -= rate * off.sum() / float(np.sqrt(squares[0][0]))
                self.linear[used] -= rate * linear / np.sqrt(squares[1][used])
                self.factors[used] -= rate * factors / np.sqrt(squares[2][used])
        return self


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Machine:
    """A machine learnt from labelled documents that aren't held out; sample bounds how many."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch):
                first, dims, values = featured(data, offsets)
                pairs = [(dims[a:b].astype(np.int16).tobytes(), values[a:b].astype(np.float32).tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["doc_id", "label", "dims", "values"])

    got = sorted(rows.mapInArrow(run, "doc_id long, label int, dims binary, values binary").collect())
    machine = Machine()
    if got:
        machine.fit([(np.frombuffer(r["dims"], np.int16).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(float)) for r in got], np.array([r["label"] for r in got], float))
    else:
        machine.factors[:] = 0
    return machine


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, limit=1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.score(*featured(data, offsets)))], ["doc_id", "score"])

    got = texts(docs).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return scored(docs, fitted(docs, labels, sample))
