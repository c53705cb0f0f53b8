"""The training-data operators on small invented documents, against brute force, exact round trips and held-out labels."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict, deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trickstat.llm import lm_scoring, media, mixing, ngram_join, packing, quality_fm, quality_rules, secret_scan, suffix_dedup, warc
from trickstat.llm.arrays import slices

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def invented(n=60, seed=5):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeéio") for _ in range(rnd.randint(2, 7))) for _ in range(150)]
    say = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, out = say(40), []
    for i in range(n):
        text = say(rnd.randint(1, 120))
        if i % 6 == 1:
            text = out[rnd.randrange(len(out))] or "x"
        if i % 6 == 2 and out:
            w = (out[rnd.randrange(len(out))] or "x y").split(" ")
            w[rnd.randrange(len(w))] = "edit"
            text = " ".join(w)
        if i % 7 == 3:
            text = text[: len(text) // 2] + " " + passage + "\n" + text[len(text) // 2 :]
        if i % 11 == 5:
            text = (say(3) + " ") * 30
        out.append(text)
    out[4], out[9], out[13], out[14] = None, "", " \n\t ", "one"
    return [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s1", "s2"]), len(t or ""), "x") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(invented(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, repeated rows, one id with two texts."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
    return spark.createDataFrame([(1, long, "en", "s", 1, None), (1, long, "en", "s", 1, None), (1, long + " more", None, None, None, None), (None, long, "en", "s", 1, None), (2, None, None, None, None, None), (3, "", "en", "s", 0, None)], SCHEMA)


def test_lm_scores(docs, odd, nothing):
    rows = docs.collect()
    pairs, contexts, after = Counter(), Counter(), Counter()
    seqs = {r.doc_id: list(zip(["<s>", *w], [*w, "</s>"], strict=True)) if (w := words_of(r.text)) else [] for r in rows}
    for s in seqs.values():
        pairs.update(s)
        contexts.update(a for a, _ in s)
        after.update(b for _, b in s)
    total = sum(pairs.values())
    for r in lm_scoring.scores(docs).collect():
        want = sum(math.log(pairs[p] / contexts[p[0]]) if pairs[p] >= 2 else math.log(0.4 * after[p[1]] / total) for p in seqs[r.doc_id])
        assert r.n_predictions == len(seqs[r.doc_id]) and r.log_score == pytest.approx(want, abs=1e-3)
    got = lm_scoring.scores(odd).collect()
    assert len(got) == 6 and len({r.log_score for r in got if r.doc_id == 1}) == 2
    assert lm_scoring.scores(nothing).count() == 0


def test_secrets_in_layers(spark, nothing):
    secret = "password = hunter2hunter2"
    b64 = lambda x: base64.b64encode(x).decode()
    layered = [b64(secret.encode()), b64(b64(secret.encode()).encode()), b64(zlib.compress(secret.encode())), b64(gzip.compress(zlib.compress(secret.encode()))), "".join(f"%{c:02X}" for c in secret.encode()), "".join(f"\\u{ord(c):04x}" for c in secret), b64("".join(f"%{c:02x}" for c in secret.encode()).encode())]
    for code in layered:
        text = f"é before {code} after"
        base, every = secret_scan.secrets(text)
        assert not [x for x in base if x[2] == "assign"] and (9, 9 + len(code), "assign") in every
        assert secret_scan.masked(text) == "é before [SECRET] after"
    plain = "Token: 'abcdefghijkl' AKIA" + "Q" * 16 + " " + "0a" * 8 + " token=short secret=" + "z" * 12
    assert [(k, s) for s, _, k in secret_scan.secrets(plain)[0]] == [("assign", 0), ("access", 22), ("hex", 43), ("assign", 72)]
    loop = b64(b"%25" * 20)
    assert secret_scan.secrets(loop) == ([], [])
    df = spark.createDataFrame([(1, plain, "x"), (2, None, "y"), (3, "", None), (None, layered[0], "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secret_scan.secret_spans(df).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (2, 1, 1) and got[2].spans == "" and got[None].n_assign == 0 and got[None].n_layered == 1
    clean = {r.doc_id: r for r in secret_scan.redacted(df).collect()}
    assert clean[2].text is None and clean[None].text == "[SECRET]" and clean[1].spans == "x" and "hunter" not in str(clean)
    assert secret_scan.secret_spans(nothing).count() == 0


def test_secrets_at_each_place():
    token = base64.b64encode(b"password = hunter2hunter2").decode()
    url = "".join(f"%{c:02X}" for c in token.encode())
    text = f"{token} and {token}, {url} or {url}"
    assert sorted({s for s, _, _ in secret_scan.secrets(text)[1]}) == [m.start() for m in re.finditer(r"\S{22,}", text.replace(",", " "))]
    assert secret_scan.masked(text) == "[SECRET] and [SECRET], [SECRET] or [SECRET]"
    wrapped = base64.b64encode(f"{token} and {token}".encode()).decode()
    assert secret_scan.masked(f"{wrapped} {wrapped}") == "[SECRET] [SECRET]"


def test_secrets_where_rows_meet(spark):
    token = base64.b64encode(b"password = hunter2hunter2").decode()
    rows = ["the end of a", "deadbeefdeadbeef is first", "", "0a" * 8, "0b" * 8, None, "ends in x", f"{token} is first"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.base_spans, r.n_layered) for r in secret_scan.secret_spans(df).collect()}
    assert got == {0: ("", 0), 1: ("hex:0:16", 0), 2: ("", 0), 3: ("hex:0:16", 0), 4: ("hex:0:16", 0), 5: ("", 0), 6: ("", 0), 7: ("", 1)}
    assert [r.text for r in secret_scan.redacted(df).orderBy("doc_id").collect()][3:5] == ["[SECRET]", "[SECRET]"]


def test_secrets_in_whole_streams():
    secret, b64 = b"password = hunter2hunter2", lambda x: base64.b64encode(x).decode()
    long = ("é, " * (33 << 20)).encode() + secret
    layered = [b64(gzip.compress(long, 1)), b64(gzip.compress(b"first, ") + gzip.compress(secret)), b64(gzip.compress(b"first") + secret)]
    noise = b64(zlib.compress(random.Random(3).randbytes(300).hex(" ").encode() + b" " + secret))
    for width in (20, 64, 76):
        for end in ("\n", "\r\n"):
            layered.append(end.join(noise[i : i + width] for i in range(0, len(noise), width)))
    layered.append("\n".join(b64(secret)[i : i + 16] for i in range(0, 36, 16)))
    for code in layered:
        for before, after in (("é: ", " after"), ("so\n", "\n\nafter"), ("", "")):
            assert (len(before), len(before + code), "assign") in secret_scan.secrets(before + code + after)[1]
            assert secret_scan.masked(before + code + after) == before + "[SECRET]" + after or before == "so\n"
    data = np.frombuffer(layered[-1].encode(), np.uint8)
    assert secret_scan._suspects(data, np.array([0, len(data)]), [layered[-1]]) == {0}


def deflated(data):
    made = zlib.compressobj(9, zlib.DEFLATED, -15)
    return made.compress(data) + made.flush()


def test_secrets_in_damaged_layers(spark):
    secret, b64 = b"password = hunter2hunter2", lambda x: base64.b64encode(x).decode()
    url = lambda x: "".join(f"%{c:02X}" for c in x)
    plain = [b64(b"\x01 " + secret), b64(b"\xff\xfe " + secret), b64(deflated(secret + b" and more " * 9)), url(zlib.compress(secret)), b64(url(zlib.compress(secret)).encode())]
    for code in plain:
        for before, after in (("é: ", " after"), ("", "")):
            assert (len(before), len(before + code), "assign") in secret_scan.secrets(before + code + after)[1]
            assert secret_scan.masked(before + code + after) == before + "[SECRET]" + after
    for code, start in ((url(b"\xff" + secret), 3), (url(secret) + "%C3", 0), ("\\ud800" + "".join(f"\\u{c:04x}" for c in secret), 6)):
        assert [x for x in secret_scan.secrets(code)[1]] == [(start, start + len(code) - (3 if start != 6 else 6), "assign")]
    rnd = random.Random(12)
    for _ in range(300):  # any nesting is found where it stands, and masking leaves none
        code, data = "", secret
        for _ in range(rnd.randint(1, 4)):
            kind = rnd.randrange(6)
            data = [lambda d: b64(d).encode(), lambda d: url(d).encode(), lambda d: b64(zlib.compress(d)).encode(), lambda d: b64(gzip.compress(d)).encode(), lambda d: url(zlib.compress(d)).encode(), lambda d: b64(d + b"\x02").encode()][kind](data)
        code = data.decode()
        text = f"x {code} y {code} z"
        assert {(2, 2 + len(code), "assign"), (5 + len(code), 5 + 2 * len(code), "assign")} <= set(secret_scan.secrets(text)[1]) or code.endswith("%02")
        assert secret_scan.secrets(secret_scan.masked(text))[1] == []


def test_classifier_learns(spark, nothing):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["good", "calm", "tree", "river"]) if i % 3 else rnd.choice(["BUY!!", "***", "NOW!!", "$$$"]) for _ in range(rnd.randint(3, 40))), i % 3 > 0) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(q), 0) for i, _, q in rows] + [(5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_fm.classified(docs, labels).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert len(got) == 302 and {i for i in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i].predicted == rows[i][2] for i in held) / len(held) > 0.95
    assert 0 <= got[900].score <= 1 and got[900].score == got[901].score
    assert quality_fm.classified(docs, labels.where("1 = 0")).where("score <> 0.5").count() == 0
    assert quality_fm.classified(nothing, labels).count() == 0


def test_machine_is_the_pairwise_sum():
    machine = quality_fm.Machine(1)
    dims, values = np.array([3, 70, 4100]), np.array([0.5, -1.0, 2.0])
    machine.linear[:] = 0.1
    pair = sum(machine.factors[dims[i]] @ machine.factors[dims[j]] * values[i] * values[j] for i in range(3) for j in range(i))
    assert machine.margin(np.array([0, 3]), dims, values)[0][0] == pytest.approx(0.15 + pair)


def test_mixing(spark, docs, odd, nothing, monkeypatch):
    import duckdb

    table = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", table)
    key = lambda r: tuple(sorted((k, str(v)) for k, v in r.items()))
    want = con.sql(mixing.mixed_sql()).df()
    got = mixing.mixed(docs).toPandas()[list(want.columns)]
    assert sorted(map(key, got.to_dict("records"))) == sorted(map(key, want.to_dict("records")))
    cells = spark.createDataFrame([("a", "x", "t", 100), ("a", "y", "t", 50), ("b", "x", "t", 10), ("b", "y", "t", 40)], "source string, lang string, topic string, tokens long")
    even = lambda *names: spark.createDataFrame([(n, 1 / len(names)) for n in names], "value string, share double")
    targets = {"source": even("a", "b"), "lang": even("x", "y"), "topic": even("t")}
    for per_task in (500_000, 1):
        monkeypatch.setattr(mixing, "CELLS_PER_TASK", per_task)
        fitted = mixing.raked(cells, targets).collect()
        for margin in ("source", "lang"):
            sums = defaultdict(float)
            for r in fitted:
                sums[r[margin]] += r.weight
            assert all(s == pytest.approx(100, abs=1e-6) for s in sums.values())
        monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert mixing.mixed(odd).count() == 6 and mixing.mixed(nothing).count() == 0 and mixing.sampled(nothing).count() == 0
    clashing = docs.withColumns({n: F.lit("mine") for n in ("row", "weight", "rate", "tokens", "n_tokens", "topic", "copies", "total", "held", "before", "share_lang", "_source")})
    kept = mixing.sampled(clashing)
    assert kept.columns == clashing.columns and kept.subtract(clashing).count() == 0
    assert Counter(r.doc_id for r in kept.collect()) == {r.doc_id: r.copies for r in mixing.mixed(docs).collect() if r.copies}


def test_margins_that_cannot_all_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "t", 100), ("b", "y", "t", 60), ("b", "y", "u", 40)], "source string, lang string, topic string, tokens long")
    want = lambda **shares: spark.createDataFrame(list(shares.items()), "value string, share double")
    got = {(r.margin, r.value): r for r in mixing.margins(cells, {"source": want(a=0.5, b=0.5), "lang": want(x=0.7, y=0.3), "topic": want(t=0.9, u=0.1)}).collect()}
    reached = {k: round(r.reached, 6) for k, r in got.items()}
    assert reached == {("source", "a"): 0.7, ("source", "b"): 0.3, ("lang", "x"): 0.7, ("lang", "y"): 0.3, ("topic", "t"): 0.9, ("topic", "u"): 0.1}
    assert {k for k, r in got.items() if not r.met} == {("source", "a"), ("source", "b")} and got["source", "b"].target == 0.5 and got["source", "b"].tokens == 100
    got = {(r.margin, r.value): r for r in mixing.margins(cells, {"source": want(a=0.6, b=0.3, c=0.1)}).collect()}
    assert (got["source", "c"].tokens, got["source", "c"].reached, got["source", "c"].met) == (0, 0, False)
    assert sum(r.target for k, r in got.items() if k[0] == "topic") == pytest.approx(1) and got["topic", "u"].target == pytest.approx(40**0.8 / (40**0.8 + 160**0.8))
    assert all(r.met for k, r in got.items() if k[0] == "topic") and mixing.margins(cells.where("1 = 0")).count() == 0


def test_sample_has_the_target_shares(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h i j", "en", "A" if i % 10 else "B") for i in range(2000)], "doc_id long, text string, lang string, source string")
    targets = {"source": spark.createDataFrame([("A", 0.5), ("B", 0.5)], "value string, share double")}
    n = {r.source: r["count"] for r in mixing.sampled(docs, targets).groupBy("source").count().collect()}
    assert n["B"] == 1000 and n["A"] == pytest.approx(1000, rel=0.06)


def test_packing(spark, docs, odd, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = ["a  b\t c\n\nd", "x   y", "tail \n", " lead", "it's 12,5 %\r\n ok", "日本 語 text", "<|endoftext|> a", *(r.text or "" for r in docs.collect())]
    rnd = random.Random(3)
    texts += ["".join(rnd.choice("ab '\n\r\t 1é日_%<|> ") for _ in range(rnd.randint(1, 60))) for _ in range(3000)] + ["a" * 3000, " " * 3000 + "x"]
    want = [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    ours = packing.Encoder(path)
    assert [ours.encode(t, True) for t in texts] == want and [ours.encode(t, False) for t in texts[:-2]] == want[:-2]
    batch = pa.record_batch({"text": ["a" * 1001, "a " * 3000, " " * 1002, None, "", "a" * 1000 + " " + "b" * 1000]})
    assert [packing.long_runs(data, offsets).tolist() for _, data, offsets in slices(batch)] == [[True, False, True, False, False, False]]
    for capacity in (16, 40):
        got = packing.pack_documents(docs, path, capacity).collect()
        ids = {r.doc_id: [*whole.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
        fill = defaultdict(list)
        for r in got:
            piece = ids[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and r.length <= capacity
            fill[r.sequence_id].append((r.offset, r.length))
        for d, x in ids.items():
            pieces = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == d)
            assert sum(p[2] for p in pieces) == len(x) and all(p[2] == capacity for p in pieces[1:])
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(fill) <= 1.03 * -(-sum(map(len, ids.values())) // capacity) + 1
    small = packing.packed(packing.tokenized(docs, path, 40), 40, per_partition=10)
    assert small.count() == len(got) and small.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 40").count() == 0
    assert packing.lower_bound(np.array([6, 6, 6, 5, 5]), 10) == 4 and packing.lower_bound(np.zeros(0, int), 10) == 0
    assert packing.pack_documents(nothing, path).count() == 0 and packing.pack_documents(odd, path).count() == 6


def rules(text):
    w = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_rules(spark, docs, odd, nothing):
    more = docs.unionByName(spark.createDataFrame([(500, "a b | c\na b | c\n \n \nd <e> #" * 4, "en", "s", 1, ""), (501, "x " * 900 + "ö" * 50, "en", "s", 1, "")], SCHEMA))
    got = {r.doc_id: r for r in quality_rules.judged(more).collect()}
    for r in more.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == rules(r.text)
        assert not (g.base_failed and g.kept)
    passed = quality_rules.passing(more)
    assert passed.columns == more.columns and {r.doc_id for r in passed.collect()} == {i for i, g in got.items() if g.kept}
    assert quality_rules.judged(odd).count() == 6 and quality_rules.judged(nothing).count() == 0 and quality_rules.passing(nothing).count() == 0


def plain_kneser_ney(texts):
    """Modified Kneser-Ney by dictionaries: log probability of the last of three code points."""
    full = Counter()
    for t in texts:
        full.update(zip("\n\n" + t, "\n" + t, t, strict=False))

    def level(counts, lower):
        n = {k: max(1, sum(v == k for v in counts.values())) for k in (1, 2, 3, 4)}
        y = n[1] / (n[1] + 2 * n[2])
        cut = {k: min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.1), k - 0.1) for k in (1, 2, 3)}
        total, mass = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            mass[g[:-1]] += cut[min(c, 3)]

        def p(g):
            context = g[:-1]
            if not total[context]:
                return lower(g[1:])
            c = counts.get(g, 0)
            return (c - (cut[min(c, 3)] if c else 0)) / total[context] + mass[context] / total[context] * lower(g[1:])

        return p

    pairs = Counter(g[1:] for g in full)
    singles = Counter(g[1:] for g in pairs)
    one = level(singles, lambda g: 1 / (len(singles) + 1))
    two = level(pairs, one)
    return level(full, two), [c for (c,) in singles]


def plain_perplexity(p, text):
    rows, line, size = [], 0.0, 0
    for i, c in enumerate(text):
        line -= math.log(p((("\n\n" + text)[i], ("\n" + text)[i], c)))
        size += 1
        if c == "\n" or i == len(text) - 1:
            rows.append((line / size, size))
            line, size = 0.0, 0
    upto = 0
    for value, size in sorted(rows):
        upto += size
        if 2 * upto >= len(text):
            return value


@pytest.mark.parametrize("entries", [4_000_000, 0])
def test_perplexity_is_plain_kneser_ney(spark, docs, odd, monkeypatch, entries):
    monkeypatch.setattr(quality_rules, "BROADCAST_ENTRIES", entries)
    chinese = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏"
    rnd = random.Random(6)
    more = docs.drop("extra").unionByName(spark.createDataFrame([(600 + i, "".join(rnd.choice(chinese + "12\n") for _ in range(90)), "zh", "s", 0) for i in range(8)] + [(620, "x", "zh", "s", 0)], SCHEMA.replace(", extra string", "")))
    more = more.withColumns({n: F.lit("mine") for n in ("row", "code", "line", "key", "bin", "center", "text_hash", "n_words", "log_ppl")})
    rows = more.collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r.lang or ""].append(re.sub("[0-9]", "0", r.text or ""))
    models = {lang: plain_kneser_ney(ts) for lang, ts in texts.items()}
    for p, symbols in models.values():
        for context in (("\n", "\n"), tuple(symbols[:2]), ("?", symbols[0]), ("?", "!")):
            assert sum(p((*context, c)) for c in [*symbols, "\0"]) == pytest.approx(1)
    got = {r.doc_id: r for r in quality_rules.judged(more).collect()}
    values = defaultdict(list)
    for r in rows:
        want = plain_perplexity(models[r.lang or ""][0], re.sub("[0-9]", "0", r.text)) if r.text else None
        assert got[r.doc_id].log_ppl == (want and pytest.approx(want, abs=1e-5))
        if r.text:
            values[r.lang or ""].append(round(got[r.doc_id].log_ppl / 0.001))
    for r in rows:
        if r.text:
            v, g = np.array(values[r.lang or ""]), got[r.doc_id]
            center, spread = np.median(v) * 0.001, max(1.4826 * 0.001 * np.median(abs(v - np.median(v))), 0.02)
            assert (g.lower + g.upper) / 2 == pytest.approx(center) and g.upper - g.lower >= 7 * spread - 1e-9
            assert g.kept == (not g.base_failed and g.lower <= g.log_ppl <= g.upper)
    passed = quality_rules.passing(more)
    assert passed.columns == more.columns and {r.doc_id for r in passed.collect()} == {i for i, g in got.items() if g.kept}
    assert quality_rules.judged(odd).count() == 6


def test_model_backs_off():
    keys = np.array([1 << 42 | 2 << 21 | 3, 2 << 21 | 3, 3, 1 << 21 | 2, 2, 0])
    model = quality_rules.Model(np.arange(6), keys, np.array([-1, -2, -4, -0.5, -0.25, -8], np.float32))
    code = lambda *x: x[0] << 42 | x[1] << 21 | x[2]
    got = model.log_probability(np.array([code(1, 2, 3), code(9, 2, 3), code(1, 2, 9), code(8, 8, 3), code(8, 8, 9)], np.uint64))
    assert got.tolist() == [-1, -2, -8.75, -4, -8]


def repeats(texts, least):
    first, out = set(), []
    for t in texts:
        data, mask = t.encode(), bytearray(len(t.encode()))
        for s in range(len(data) - least + 1):
            w = data[s : s + least]
            if w in first:
                mask[s : s + least] = b"\1" * least
            first.add(w)
        out.append((len(data), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(bytes(b for b, m in zip(data, mask, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("least", [100, 64])
def test_suffix_dedup(spark, docs, odd, nothing, least):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    more = [(100, "ab" * 300, None, None, 0, ""), (101, "z" * 99, None, None, 0, ""), (102, "q" + "z" * 99 + "é" * 80, None, None, 0, ""), (103, "é" * 80, None, None, 0, "")]
    texts = [r.text or "" for r in rows] + [m[1] for m in more]
    want = dict(zip([r.doc_id for r in rows] + [m[0] for m in more], repeats(texts, least), strict=True))
    got = suffix_dedup.deduplicated(docs.unionByName(spark.createDataFrame(more, SCHEMA)), least).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    again = suffix_dedup.deduplicated(odd, least).collect()
    assert len(again) == 6 and len({(r.doc_id, r.kept_sha256) for r in again if r.doc_id == 1}) == 2
    assert suffix_dedup.deduplicated(nothing).count() == 0


def plain_maximal_repeats(docs, least):
    """{length, places} of each maximal repeat, by growing sets of places a byte at a time."""
    data = {i: (t or "").encode() for i, t in docs}
    out, open_ = set(), defaultdict(set)
    for i, t in data.items():
        for at in range(len(t) - least + 1):
            open_[t[at : at + least]].add((i, at))
    todo = [(least, g) for g in open_.values() if len(g) > 1]
    while todo:
        n, group = todo.pop()
        front = {data[i][at - 1] if at else (i, at) for i, at in group}
        after = defaultdict(set)
        for i, at in group:
            after[data[i][at + n] if at + n < len(data[i]) else (i, at)].add((i, at))
        if len(front) > 1 and len(after) > 1:
            out.add((n, frozenset(group)))
        todo += [(n + 1, g) for g in after.values() if len(g) > 1]
    return out


def found_repeats(docs, *args):
    found = defaultdict(list)
    for r in suffix_dedup.maximal_repeats(docs, *args).collect():
        found[r.repeat_id, r.length].append((r.doc_id, r.start))
    assert all(len(set(g)) == len(g) for g in found.values())
    out = {(n, frozenset(g)) for (_, n), g in found.items()}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_maximal_repeats_at_random(spark, seed):
    rnd = random.Random(seed)
    pieces = ["".join(rnd.choice("abé") for _ in range(rnd.choice((20, 45, 70, 130)))) for _ in range(6)]
    docs = [(i, "".join(rnd.choice((*pieces, "x", "yz", "é")) for _ in range(rnd.randint(1, 9)))) for i in range(24)]
    docs += [(30, "ab" * 90), (31, "ab" * 70), (32, None), (33, ""), (34, docs[0][1]), (35, docs[0][1] + "!")]
    want = plain_maximal_repeats(docs, 40)
    assert len(want) > 30 and max(n for n, _ in want) > 150
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({n: F.lit("mine") for n in ("mark", "class", "piece", "node")})
    assert found_repeats(frame.repartition(3), 40, 8) == want
    assert found_repeats(frame.unionByName(frame.limit(5)), 40) == want  # a repeated row is one document


def test_maximal_repeats(spark, nothing):
    rnd = random.Random(4)
    a, b = ("".join(rnd.choice("abcdefgh") for _ in range(300)) for _ in "ab")
    docs = spark.createDataFrame([(1, f"1{a}{b}!"), (2, f"2{a}{b}?"), (3, f"3{a}Z")], "doc_id long, text string")
    assert found_repeats(docs) == {(600, frozenset({(1, 1), (2, 1)})), (300, frozenset({(1, 1), (2, 1), (3, 1)}))}
    long = "".join(rnd.choice("abcdefgh") for _ in range(suffix_dedup.BLOCK + 5_000))
    docs = [(None, f"<{long}>"), (5, f"({long})"), (5, f"[{long[700:]}]")]  # over blocks; a null id; two texts of one id
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    assert found_repeats(docs) == {(len(long), frozenset({(None, 1), (5, 1)})), (len(long) - 700, frozenset({(None, 701), (5, 701), (5, 1)}))}
    assert suffix_dedup.maximal_repeats(nothing).count() == 0
    assert suffix_dedup.deduplicated(spark.createDataFrame([(1, "ab" * 400), (2, "ab" * 300)], "doc_id long, text string"), 300).agg(F.sum("n_removed")).first()[0] == 798 + 600
    scan = suffix_dedup.interval_scan([0, 5, 7, 5, 0], [3, 1, 2, 0, 9])
    assert scan == [5, 5, 7, 0, 0]


def test_warc(spark, tmp_path):
    big = "<p>" + "ö\r\n\r\nWARC/1.1\r\n" * 20
    pages = spark.createDataFrame([(3, "http://www.B.com/x?q#f", big), (1, "https://a.org/1", big), (2, None, "short"), (5, "u\r\nX: y", "short"), (4, "http://a.org/1", None), (None, "http://z.net", big), (7, "http://a.org/1", "")], "page_id long, url string, html string")
    got = warc.capture_histories(pages).collect()
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    want = {r.page_id: (len((r.html or "").encode()), sha(r.html), *(("revisit", 1) if r.html == big and r.page_id != 1 else ("response", None))) for r in pages.collect()}
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want
    order = [(r.url_key, r.captured_at) for r in got]
    assert order == sorted(order) and ("com,b)/x?q", "2024-01-01T00:00:03Z") in order
    assert warc.capture_histories(pages.where("1 = 0")).count() == 0
    rnd = random.Random(1)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(rnd.choices(range(50), k=rnd.randint(0, 9))) for _ in range(k)]
        tree = warc.LoserTree([deque((x, x) for x in r) for r in runs])
        assert [*tree.upto(20), *tree.upto(None)] == sorted(x for r in runs for x in r)
    path = warc.archived(pages, str(tmp_path / "warc"), 2)
    archives = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    assert len(archives) > 2
    for r in warc.captures(spark, path).collect():
        record = warc.record_at(archives[r.run], r.offset, r.length)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"X-Page-ID: {r.page_id if r.page_id is not None else ''}\r\n".encode() in record


def test_runs_merge_in_blocks(spark):
    rnd = random.Random(4)
    rows = [(f"run{rnd.randrange(7)}", rnd.choice("abcdef") * rnd.randint(1, 3), f"t{rnd.randrange(9)}", rnd.choice([None, *range(20)]), i, "d", "response", None, 0, 1) for i in range(400)]
    got = [tuple(r) for r in warc.merged(spark.createDataFrame(rows, warc.CAPTURE), 3).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str) and [warc._key(r) for r in got] == sorted(warc._key(r) for r in rows)


def test_media(spark, docs, odd, nothing):
    html = '<h1>A&amp;b</h1><script>x</script>one <img src="sha256:d1" alt="alt"> two<figure><img src=sha256:d2><figcaption>the <b>cap</b></figcaption></figure>end'
    items = media.items_of(html)
    assert [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in items] == [("text", "A&bone", None), ("media", "d1", "alt"), ("text", "two", None), ("media", "d2", "the cap"), ("text", "end", None)]
    kinds = lambda html: [(i["kind"][0], i["text"] or i["digest"], i["caption"]) for i in media.items_of(html)]
    assert kinds("a<figcaption>b</figcaption>c") == [("t", "a", None), ("t", "b c", None)]
    assert kinds("<figure><img src=x><figcaption>cap</figure>after") == [("m", "x", "cap"), ("t", "after", None)]
    assert kinds("<figure><figcaption>left open <img data-src=x>") == [("m", "x", "left open")]
    nested = "<figure><figure><img src=x><figcaption>in</figcaption></figure><img srcset='y 1x, z 2x'><figcaption>out</figcaption></figure>"
    assert kinds(nested) == [("m", "x", "in"), ("m", "y", "out")] and kinds("<figure>a<figcaption>b</figcaption>c</figure>") == [("t", "a", None), ("t", "b", None), ("t", "c", None)]
    pages = spark.createDataFrame([(1, html, "k", "mine", "own"), (2, None, "k", None, None)], "page_id long, html string, digest_of string, items string, position string")
    store = spark.createDataFrame([("d2", 7)], "digest string, size int")
    got = {(r.page_id, r.position): (r.digest, r.caption, r["size"]) for r in media.resolved(media.sequences(pages), store).collect()}
    assert got == {(1, 1): ("d1", "alt", None), (1, 3): ("d2", "the cap", 7)}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in media.text_media(docs).collect():
        raw = texts[r.doc_id]
        items = media.items_of(media.page_of(raw.decode())[1])
        assert items[r.position]["kind"] == "media" and " ".join(i["text"] for i in items if i["text"]) == " ".join(raw.decode().split())
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        image = media.png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.samples(image) == payload and (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())
    with pytest.raises(ValueError):
        media.samples(media.png(bytes(64))[:-5] + b"12345")
    assert media.text_media(odd).count() == 6 and media.text_media(nothing).count() == 0


def test_media_of_pages():
    kinds = lambda html: [(i["text"] or i["digest"], i["caption"]) if i["kind"] == "media" else i["text"] for i in media.items_of(html)]
    assert kinds("a<noscript>b<p>c</p>d <img src=x>") == ["abcd", ("x", None)]  # without an end it hides nothing
    assert kinds("a<noscript>b<img src=y></noscript>c<template>d<figure><img src=z></figure></template>e") == ["ace"]
    assert kinds("a<script>b <p>c</p>") == ["a"] and kinds("a<style>b</style>c</template>d") == ["acd"]
    assert kinds("a<noscript><noscript>b</noscript>c") == ["ac"] and kinds("<template>a<noscript>b</template>c") == ["c"]
    assert kinds("a<picture>b<source srcset='s 1x'><source srcset=t><img src=x alt=cap></picture>c") == ["a", ("x", "cap"), "bc"]
    assert kinds("<picture><source srcset='s 1x, t 2x'></picture><source src=u>") == [("s", None), ("u", None)]
    assert kinds("<video src=v><source src=w><img src=x></video><audio><source src=a><source src=b></audio>") == [("v", None), ("a", None)]
    assert kinds("<video src=v>a<img src=x>") == [("v", None), "a", ("x", None)] and kinds("<video/><audio src=q/>a") == [("q/", None), "a"]
    assert kinds("<figure><picture><source srcset=s><img></picture><video src=v></video><figcaption>cap</figcaption></figure>") == [("s", "cap"), ("v", "cap")]
    rnd = random.Random(8)
    parts = ["<picture>", "</picture>", "<video src=v>", "</video>", "<noscript>", "</noscript>", "<figure>", "</figure>", "<figcaption>", "</figcaption>", "<img src=x>", "<source src=s>", "w ", "&amp;"]
    for _ in range(500):
        html = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        items = media.items_of(html)
        assert [i["position"] for i in items] == list(range(len(items)))
        if "noscript" not in html:
            shown = " ".join([t for i in items for t in (i["text"] or "", i["caption"] or "")])
            assert ("w" in shown) == ("w" in html)
            assert any(i["kind"] == "media" for i in items) == ("src" in html)


def linked(rows, num=75, den=100):
    sets = {}
    for i, t in rows:
        w = words_of(re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("bounds", [None, dict(FREQUENT=2, VERY_FREQUENT=4, SMALL=8, LARGE=2, BLOCK=3), dict(FREQUENT=3, VERY_FREQUENT=5, LARGE=3, BLOCK=2)])
def test_ngram_join(spark, docs, odd, nothing, monkeypatch, bounds):
    for name, value in (bounds or {}).items():
        monkeypatch.setattr(ngram_join, name, value)
    rnd = random.Random(8)
    core = [f"w{i}" for i in range(60)]
    more = []
    for i in range(25):
        w = list(core)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"e{rnd.randrange(400)}"
        more.append((200 + i, " ".join(w), "en", "s", 1, ""))
    every = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    want = linked([(r.doc_id, r.text) for r in every.collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(every).collect()}
    assert got == want
    kept = ngram_join.representatives(every)
    assert kept.columns == every.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}
    if bounds is None:
        strange = ngram_join.near_duplicates(odd).collect()
        assert len(strange) == 6 and {r.component_id for r in strange if r.n_shingles} == {1}
        assert ngram_join.near_duplicates(nothing).count() == 0 and ngram_join.representatives(nothing).count() == 0


def test_ngram_join_of_tasks_that_begin_alike(spark):
    rnd = random.Random(9)
    say = lambda: [f"v{rnd.randrange(5000)}" for _ in range(80)]
    same, rows = " ".join(say()), []
    originals = [say() for _ in range(10)]
    for part in range(4):
        rows.append((100 * part, same))
        rows += [(100 * part + 1 + i, " ".join([*w[: 10 * part], "edit", *w[10 * part + 1 :]])) for i, w in enumerate(originals)]
    got = ngram_join.near_duplicates(spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows) and len({r.component_id for r in got}) == 11


def test_pipeline_stages(spark, docs, tmp_path):
    """Each stage against a plain version of it on what the one before kept."""
    import corpus_pipeline

    docs.drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in now.collect()}
        now = stage(spark, now, str(tmp_path))
        after = {r.doc_id: r for r in now.collect()}
        assert now.columns == columns and set(after) <= set(before), name
        if name == "quality_rules":
            assert set(after) == {r.doc_id for r in quality_rules.judged(docs).collect() if r.kept}
        if name == "ngram_jaccard_join":
            groups = linked([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        if name == "secret_scans":
            assert all(after[i].text == (r.text and secret_scan.masked(r.text)) and after[i].n_chars == len(after[i].text) for i, r in before.items())
        if name == "mixing_weights":
            assert all(after[i] == before[i] for i in after)
        kept.append(len(after))
    assert kept == sorted(kept, reverse=True)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(after)


def test_hashes_of_strings_that_cancel_out(spark, monkeypatch):
    """Thue-Morse words and their complements are equal under any polynomial modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 12))
    other = word.translate(str.maketrans("ab", "ba"))
    made = spark.createDataFrame([(1, word), (2, other), (3, f"{word}\n{other}\n{word}"), (4, word)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(made).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}
    data = np.frombuffer(f"{word}\n{other}\n{word}".encode(), np.uint8)
    assert quality_rules._measure(data, np.array([0, len(data)]))[3].tolist() == [1]
    monkeypatch.setattr(quality_rules, "spans_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    lines = np.frombuffer(b"a\nb\na\nc d\nb", np.uint8)
    assert quality_rules._repeats(lines, np.array([0, 2, 4, 6, 10]), np.array([1, 3, 5, 9, 11]), np.array([0, 0, 0, 0, 1]), 2).tolist() == [1, 0]
    scored = {r.doc_id: r for r in lm_scoring.scores(made.where("doc_id < 3")).collect()}
    assert scored[1] != scored[2]
