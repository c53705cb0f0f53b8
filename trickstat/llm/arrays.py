"""Texts of an Arrow batch as flat NumPy arrays: words, 64-bit word hashes, shingles; packed rows for shuffles.

A batch is worked on in slices of a few MB of text, so a task's memory depends on the slice and
the longest text, never on the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits (splitmix64's finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_weights = {"all": np.ones(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 1024)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and offsets (one more than texts). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (bytes_[:0], np.zeros(1, np.int64))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of whole texts, at most limit bytes together or one text."""
    data, offsets = flat(batch.column(text))
    low, n = 0, batch.num_rows
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words ([^\\x20\\x09-\\x0D]+), and the number of words before each text (one more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    return starts, np.flatnonzero(~space & after) + 1, np.searchsorted(starts, offsets)


def weights(n: int) -> np.ndarray:
    """n odd 64-bit weights without structure, one for each place in a span."""
    if len(_weights["all"]) < n:
        _weights["all"] = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    return _weights["all"]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are in order and don't overlap.

    A sum of byte values, each times the weight of its place in the range. Weights follow no powers, so strings built
    to cancel out in a polynomial (Thue-Morse words and their complements) differ here.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    low, longest = int(starts[0]), int((ends - starts).max())
    part = data[low : int(ends[-1])]
    place = np.arange(low, low + len(part)) - np.repeat(starts, np.diff(np.append(starts, ends[-1])))
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_BYTE[part] * weights(longest)[np.minimum(place, max(longest - 1, 0))], out=total[1:])
    return mix(total[ends - low] - total[starts - low])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row (over all words; the caller drops those across texts)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * _STEP + words[k : len(words) - n + 1 + k]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: n words, or all words if there are fewer; A-Z count as a-z."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets)
    words = spans_hash(data, starts, ends)
    grams = ngrams(words, n)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= n:
            got = np.sort(grams[low : high - n + 1])
            yield got[np.concatenate(([True], got[1:] != got[:-1]))] if len(got) > 1 else got
        elif high > low:
            yield mix(ngrams(words[low:high], high - low) + np.uint64(high - low))
        else:
            yield np.zeros(0, np.uint64)


def by_bucket(bucket: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket starts in it (count + 1 values)."""
    order = np.argsort(bucket.astype(np.uint16 if count < 65536 else np.uint32), kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=count))))


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: what they have in common compresses."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, len(data) // width).T).view(dtype).ravel()


def pack(*columns: np.ndarray) -> bytes:
    """Columns in one compressed value; unpack() with the same types in the same order."""
    parts = [planes(c) for c in columns]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    raw = head + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(value: bytes, *types: type) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    sizes = np.frombuffer(raw[: 8 * len(types)], np.int64)
    at, out = 8 * len(types), []
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(unplanes(raw[at : at + size], kind))
        at += size
    return out
