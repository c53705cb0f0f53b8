"""Very long texts, clashing column names, repeated ids and empty tables, for each operator against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import SCHEMA, invented, repeats, rules, words_of

from trickstat.llm import lm_scoring, media, ngram_join, packing, quality_fm, quality_rules, secret_scan, suffix_dedup, warc
from trickstat.llm.arrays import SLICE_BYTES

CLASHES = ("mark", "bucket", "payload", "component", "component_id", "code", "row", "node", "leader", "digest", "position", "items", "score", "n_words", "length", "start", "bit", "id", "bits", "runs")


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def long_docs(spark):
    """Three texts beyond SLICE_BYTES (two equal, one with an edit, one word of 3,000 letters in each) between short ones."""
    rnd = random.Random(12)
    vocabulary_ = ["".join(rnd.choice("abcdeéio") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]
    words = [rnd.choice(vocabulary_) + rnd.choice([" "] * 12 + ["\n", "  "]) for _ in range(190_000)]
    words[100_000] = "w" * 3000 + " "
    long = "".join(words)
    assert len(long.encode()) > SLICE_BYTES
    edited = long[: len(long) // 2] + " Token=abcdefabcdef1234 " + long[len(long) // 2 :]
    rows = [(1, "some short text"), (2, long), (3, edited), (4, None), (5, long), (6, ""), (7, long[:500])]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], SCHEMA).repartition(2), dict(rows)


def test_long_texts_are_scored_whole(long_docs):
    docs, rows = long_docs
    pairs, contexts, after = Counter(), Counter(), Counter()
    seqs = {i: list(zip(["<s>", *w], [*w, "</s>"], strict=True)) if (w := words_of(t)) else [] for i, t in rows.items()}
    for s in seqs.values():
        pairs.update(s)
        contexts.update(a for a, _ in s)
        after.update(b for _, b in s)
    total = sum(pairs.values())
    got = {r.doc_id: r for r in lm_scoring.scores(docs).collect()}
    for i, s in seqs.items():
        want = sum(math.log(pairs[p] / contexts[p[0]]) if pairs[p] >= 2 else math.log(0.4 * after[p[1]] / total) for p in s)
        assert got[i].n_predictions == len(s) and got[i].log_score == pytest.approx(want, rel=1e-6, abs=1e-3)


def test_long_texts_are_measured_whole(spark, long_docs):
    docs, rows = long_docs
    for r in quality_rules.judged(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules(rows[r.doc_id]), r.doc_id
    found = {r.doc_id: r for r in secret_scan.secret_spans(docs).collect()}
    at = rows[3].index("Token=")
    assert f"assign:{at}:{at + 22}" in found[3].spans.split(",") and found[3].n_assign == 1 and found[2].n_assign == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, 0), (7, 0)], "doc_id long, quality int")
    scores = {r.doc_id: r.score for r in quality_fm.classified(docs, labels).collect()}
    assert len(scores) == 7 and scores[2] == scores[5] and all(0 <= s <= 1 for s in scores.values())


def test_long_texts_are_compared_whole(long_docs):
    docs, rows = long_docs
    want = dict(zip(rows, repeats([t or "" for t in rows.values()], 100), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs).collect()}
    assert got == want and got[5][1] == got[5][0]
    shingles = {}
    for i, t in rows.items():
        w = words_of(t)
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {i: (len(s), 2 if i in (3, 5) else i) for i, s in shingles.items()}


def test_long_texts_are_stored_and_packed_whole(long_docs):
    from tokenizers import Tokenizer

    docs, rows = long_docs
    for r in media.text_media(docs).collect():
        raw = (rows[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    tokenizer = Tokenizer.from_file(vocabulary())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows.items()}
    pieces = defaultdict(list)
    for r in packing.pack_documents(docs, vocabulary()).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    assert {i: sum(n for _, _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}
    assert all(n == 2048 for p in pieces.values() for _, _, n in sorted(p)[1:])


def test_further_columns_change_nothing(spark):
    docs = spark.createDataFrame(invented(24), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    clash = lambda df: df.withColumns({n: F.lit("mine") for n in CLASHES if n not in df.columns})
    same = {
        "op1": lm_scoring.scores,
        "op2": secret_scan.secret_spans,
        "op3": lambda d: quality_fm.classified(d, clash(labels) if "mark" in d.columns else labels),
        "op5": lambda d: packing.pack_documents(d, vocabulary()).select("doc_id", "piece", "start", "length", "ids_crc32"),
        "op6": quality_rules.judged,
        "op7": suffix_dedup.deduplicated,
        "op9": media.text_media,
        "op10": ngram_join.near_duplicates,
    }
    for name, operator in same.items():
        plain, more = operator(docs), operator(clash(docs))
        assert plain.columns == more.columns, name
        assert sorted(map(str, plain.collect())) == sorted(map(str, more.collect())), name
    pages = spark.createDataFrame([(1, "http://a", "<p>" + "x" * 200), (1, "http://a", "<p>" + "x" * 200), (3, None, None), (None, "http://b", "<p>" + "x" * 200)], "page_id long, url string, html string")
    more = clash(pages).withColumns({n: F.lit("mine") for n in ("run", "offset", "url_key", "captured_at", "record_type", "refers_to", "payload_digest", "payload_bytes")})
    names = ("page_id", "payload_bytes", "record_type", "refers_to")
    got = [sorted(str(tuple(r)) for r in warc.capture_histories(p).select(*names).collect()) for p in (pages, more)]
    assert got[0] == got[1] and len(got[0]) == 4  # a repeated page_id has a record for each of its rows


def test_classifier_of_repeated_and_nameless_rows(spark):
    text = "a calm river and a good tree"
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (1, "BUY *** NOW"), (2, "BUY *** NOW")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality_fm.classified(docs, labels).collect()
    assert len(got) == 5 and sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Nulls, repeated rows, two texts of one id and clashing columns through all stages; packing held against the texts."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = invented(40)
    rows += [rows[2], rows[7], (None, rows[3][1], None, None, None, None), (3, rows[8][1], None, "s1", 0, None), (99, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("mine") for n in CLASHES})
    docs.write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = corpus_pipeline.stored(stage(spark, now, str(tmp_path / "odd")), name)
        assert now.columns == docs.columns and now.where("mark <> 'mine'").isEmpty(), name
    tokenizer = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in now.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert len(ids) <= 2048
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got) == want and want
    docs.where("1 = 0").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
