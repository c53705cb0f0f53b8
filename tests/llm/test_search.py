"""Hard negatives, importance resampling and license scans against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trickstat.llm import hard_negatives, importance, license_scan
from trickstat.llm.arrays import slices

VECTORS = "vec_id long, label int, embedding array<float>, rank int, score string, block int"


def plain_negatives(rows, k=5):
    used = []
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a, label, q in used:
        if a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(q, p, strict=False)), i, l) for i, l, p in used if i != a]
        first = sorted(((-s, i) for s, i, l in scored if l == label))[:k]
        for s, p in first:
            fit = sorted((-n, i) for n, i, l in scored if l != label and 80 * -s <= 100 * n <= 100 * -s)[:k]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def vectors(n=900, dim=12, seed=1, ids=None):
    rnd = random.Random(seed)
    centers = [[rnd.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        c = centers[rnd.randrange(6) if rnd.random() < 0.7 else 0]
        v = [x + rnd.gauss(0, 0.1) for x in c] if rnd.random() < 0.6 else list(c)
        out.append((ids[i] if ids else i * 10, rnd.choice([1, 1, 1, 2, 3, 8, 9]), v))
    out[3] = (None, 1, out[3][2])
    out[4] = (out[4][0], None, out[4][2])
    out[5] = (out[5][0], 1, None)
    out[6] = (out[6][0], 1, [None, *out[6][2][1:]])
    out[7] = (out[7][0], 1, [float("nan"), *out[7][2][1:]])
    out[8] = (out[8][0], 1, [float("-inf"), *out[8][2][1:]])
    out[9] = (out[9][0], 1, out[9][2][:3])
    out[11] = (out[11][0], 2, [])
    out[20] = (out[20][0], 1, [0.0] * dim)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], VECTORS)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sizes", [None, (64, 3, 8, 16)])
def test_hard_negatives(spark, monkeypatch, sizes):
    if sizes:
        for name, size in zip(("BLOCK", "ANCHORS", "BATCH", "COLUMNS"), sizes, strict=True):
            monkeypatch.setattr(hard_negatives, name, size)
    rows = vectors()
    got = hard_negatives.mined(frame(spark, rows).repartition(3))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(got) == plain_negatives(rows) and got.count() > 500


def test_hard_negatives_of_odd_rows(spark):
    assert found(hard_negatives.mined(frame(spark, []))) == []
    assert found(hard_negatives.mined(frame(spark, [(1, 2, [1.0])]))) == []
    assert found(hard_negatives.mined(frame(spark, [(100, 2, [1.0]), (200, 2, [1.0]), (300, 3, [])]))) == []
    rows = vectors(60, 3) + vectors(60, 3, 2, [100] * 30 + [7] * 30)  # ids that occur again, each row its own
    got = hard_negatives.mined(frame(spark, rows))
    assert {r.anchor_id for r in got.collect()} >= {100} and all(r.negative_id != r.anchor_id != r.positive_id for r in got.collect())
    large = [(i * 50, i % 2, [float(2**20 * (i % 5)), 3e6]) for i in range(40)]  # beyond what doubles hold exactly
    assert found(hard_negatives.mined(frame(spark, large))) == plain_negatives(large)


def test_threshold_stops_early():
    """In skewed lists few rows are looked at, with the same result."""
    rnd = np.random.default_rng(0)
    x = np.floor(rnd.pareto(1.0, (5000, 4)) * 100).clip(0, 1e5).astype(np.float32)
    lists, looked = hard_negatives.Lists(x), 0
    anchor = np.array([[1, 2, 0, 3]], np.float32)
    for rows, depth in hard_negatives.rounds(lists, anchor):
        looked += len(rows)
        best = np.sort((anchor @ x[rows].T)[0])
        if depth and (lists.threshold(anchor, depth) < best[-1:]).all():
            break
    assert looked < 1000
    got = hard_negatives.nearest(anchor, np.array([-1]), lists, np.arange(5000), 5)
    want = sorted(((-s, i) for i, s in enumerate((anchor @ x.T)[0].tolist())))[:5]
    assert list(zip((-got[1]).tolist(), got[2].tolist(), strict=True)) == [(int(s), i) for s, i in want]


TEXTS = ["The cat, the DOG—und Äpfel\n the cat", None, "", "-- ..", "x", " ".join(f"w{i % 9}" for i in range(60)), "İstanbul É a1b2 " * 15, "the cat sat on the mat and the dog ate the hat while every other cat saw the rat twice " * 3, "ab" * 3000 + " " + "z" * 70000]


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resampled(docs, target, percent=5):
    own, other = Counter(), Counter()
    for _, t in docs:
        own.update(plain_features(t)[1])
    for t in target:
        other.update(plain_features(t)[1])
    s, t = sum(own.values()), sum(other.values())
    gain = lambda b: math.floor(1000 * math.log((other[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000))))
    out = []
    for i, text in docs:
        words, buckets = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, buckets))
        out.append([i, len(buckets), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    drawn = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0], r[1]))
    place = {id(r): n for n, r in enumerate(drawn[: percent * len(drawn) // 100], 1)}
    return sorted(((*r[:4], place.get(id(r))) for r in out), key=str)


def test_importance(spark):
    rnd = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "abcdefg" for b in ("", "é", "x1", "yy")]
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 90)))) for i in range(20, 220)]
    docs += [(None, docs[40][1]), docs[40], docs[40], (docs[40][0], docs[41][1])]
    target = [" ".join(rnd.choice(vocabulary[:9]) for _ in range(30)) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame([(*d, 5, 0.5, "q") for d in docs], "doc_id long, text string, rank int, score double, n_words string").repartition(4)
    made = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    for percent in (5, 40):
        got = importance.resampled(df, made, percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == plain_resampled(docs, target, percent)
    assert importance.resampled(df.limit(0), made).count() == 0
    assert sorted(map(tuple, importance.resampled(df, made.limit(0)).collect()), key=str) == plain_resampled(docs, [])


def test_checksums_move():
    rnd = random.Random(4)
    parts = [(rnd.randbytes(rnd.randint(0, 9)), rnd.randbytes(rnd.choice([0, 1, 5, 300, 70000]))) for _ in range(50)]
    got = importance.moved(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([len(b) for _, b in parts]))
    assert (got ^ np.array([zlib.crc32(b) for _, b in parts], np.uint32)).tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_features_of_long_and_sliced_texts():
    """Slices don't change anything: texts over the slice size, and many in one."""
    texts = [*TEXTS, "word " * 400_000, "é" * 600_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    at = 0
    for part, data, offsets in slices(batch):
        bucket, of, n_words = importance.features(data, offsets)
        for i in range(part.num_rows):
            words, want = plain_features(texts[at + i])
            assert n_words[i] == len(words) and Counter(bucket[of == i].tolist()) == Counter(want)
        at += part.num_rows
    assert at == len(texts)


def plain_base(text):
    words = license_scan.words_of(text or "")
    hits = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scans(spark):
    rnd = random.Random(7)
    filler = lambda k: " ".join(rnd.choice("the of license and software is public under general this mit copy apache version 2 0 zebra Ähre".split()) for _ in range(k))
    docs = [(0, None), (1, ""), (2, "MIT\n*License*; mit-LICENSE apache license"), (3, "general public\tlicense"), (4, "mitlicense mit licenses"), (5, "x " * 20)]
    want = {}
    for label, text, _ in license_scan.TEMPLATES:
        for _ in range(2):
            i = len(docs)
            docs.append((i, f"{filler(rnd.randint(0, 300))}\n// {text.upper() if rnd.random() < 0.5 else text}\n{filler(rnd.randint(0, 300))}"))
            want[i] = label
    docs += [(1000, filler(5000)), (1001, "mit license " * 300_000), (2, docs[2][1]), (None, "apache license")]
    long_ = "permission is hereby granted free of charge " * 50  # a key phrase without the rest
    docs.append((1002, long_))
    df = spark.createDataFrame([(*d, 1, "q", 0.5) for d in docs], "doc_id long, text string, n_words int, labels string, score double").repartition(3)
    got = sorted(license_scan.licensed(df).collect(), key=lambda r: str(r.doc_id))
    assert [r.doc_id for r in got] == sorted((i for i, _ in docs), key=str)
    texts = dict(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        if r.doc_id in want:
            assert want[r.doc_id] in r.labels.split(",") and r.score > 0.9
            place = next(m for m in r.matches if m.label == want[r.doc_id])
            assert 0 <= place.first_word <= place.last_word < r.n_words
    by = {r.doc_id: r for r in got}
    assert by[1002].labels == "" and by[1002].score == 0 and by[0].labels == "" and by[5].score == 0
    assert license_scan.licensed(df.limit(0)).count() == 0


def test_license_words_are_compared_by_bytes(monkeypatch):
    lex = license_scan.lexicon(license_scan.TEMPLATES, license_scan.BASE)
    monkeypatch.setattr(license_scan, "spans_hash", lambda data, starts, ends: np.full(len(starts), lex.hashes[5]))
    text = np.frombuffer(b"nothing of these words is meant", np.uint8)
    ids = license_scan.words_in(text, np.array([0, len(text)]), lex)[0]
    assert set(ids.tolist()) <= {-1, lex.ids[5]} and (ids == -1).sum() >= 5
