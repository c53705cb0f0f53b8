"""Large lists of terms: both ways of finding them, spans without overlaps, names in records."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from trickstat.operators import alias, terms

RULES = {"ab": "x", "abc": "long one", "bca": "", "c": "[c]", "é a": "E", "aa": "1", "aaab": "22222", "A": "up", "": "never"}


def texts(n=60, seed=3):
    rnd = random.Random(seed)
    return [(i, "".join(rnd.choice("aabbcé A\t ") for _ in range(rnd.randint(0, 60)))) for i in range(n)] + [(900, None), (901, ""), (902, "ab" * 3000)]


def frames(spark, rows, rules):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, text string, term string, start int").repartition(3)
    made = spark.createDataFrame([(k, v, 0) for k, v in rules.items()] + [(None, "n", 0), ("c", "[d]", 1)], "term string, replacement string, extra int")
    return df, made


def plain(text, rules, how, ignore_case=False):
    if text is None:
        return None
    spans, flags = [], re.I if ignore_case else 0
    pattern = "|".join(re.escape(t) for t in sorted(filter(None, rules), key=lambda t: (-len(t), t)))
    low = {k.lower(): v for k, v in sorted(rules.items(), reverse=True)} if ignore_case else rules
    for m in re.finditer(pattern, text, flags):
        spans.append((m.start(), m.end(), low[m[0].lower() if ignore_case else m[0]]))
    out, at = "", 0
    for a, b, new in spans:
        out += text[at:a] + (new[: b - a].ljust(b - a) if how == "mask" else new)
        at = b
    return out + text[at:]


@pytest.mark.parametrize("most", [terms.AUTOMATON_TERMS, 0])
def test_replacement_is_the_alternation(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "AUTOMATON_TERMS", most)
    rows = texts()
    df, rules = frames(spark, rows, RULES)
    for how, ignore in (("rules", False), ("mask", False), ("rules", True)):
        got = terms.replace_terms(df, "id", "text", rules, how, ignore)
        assert got.columns == df.columns
        assert {r.id: r.text for r in got.collect()} == {i: plain(t, RULES, how, ignore) for i, t in rows}
    spans = sorted(map(tuple, terms.term_spans(df, "id", "text", rules).collect()))
    assert spans and all(dict(rows)[i][a:b] == found for i, a, b, found in spans)
    assert {r.id: r.text for r in terms.replace_terms(df, "id", "text", rules.limit(0)).collect()} == dict(rows)
    assert terms.replace_terms(df.limit(0), "id", "text", rules).count() == 0
    with pytest.raises(ValueError):
        terms.replace_terms(df, "id", "text", rules, "other")


@pytest.mark.parametrize("most", [terms.AUTOMATON_TERMS, 0])
def test_columns_stay_aligned(spark, monkeypatch, most):
    monkeypatch.setattr(terms, "AUTOMATON_TERMS", most)
    names = {"adam": "Bo", "eve": "Clarissa", "adam smith": "Q"}
    rows = list(enumerate(["adam      12", "ADAM 12", "the adam", "adam-eve    7", "Adam, eve x", "", "eve adam smith  eve   9", None]))
    df, rules = frames(spark, rows, names)
    rules = rules.where("term <> 'c'")
    got = {r.id: r.text for r in terms.replace_terms(df, "id", "text", rules, "aligned", True).collect()}
    want = {r.id: r.t for r in df.select("id", alias.replace_aligned(F.col("text"), names).alias("t")).collect()}
    assert got == want and got[0] == "Bo        12"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_a_hundred_thousand_names(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    words = sorted({w for r in df.collect() for w in re.findall(r"\w{4,}", r.text or "")})
    names = [*words[::3], *(a + " " + b for a, b in zip(words[1::7], words[2::7], strict=False))]
    names += [f"name {i} of none" for i in range(100_000 - len(names))]
    rules = spark.createDataFrame([(n, f"<{i}>") for i, n in enumerate(names)], "term string, replacement string")
    one = {r.doc_id: r.text for r in terms.replace_terms(df, "doc_id", "text", rules).collect()}
    monkeypatch.setattr(terms, "AUTOMATON_TERMS", 1000)
    assert {r.doc_id: r.text for r in terms.replace_terms(df, "doc_id", "text", rules).collect()} == one
    assert sum(r.text != one[r.doc_id] for r in df.collect()) > 100


def test_large_lists_send_strings_not_places(spark, monkeypatch):
    monkeypatch.setattr(terms, "AUTOMATON_TERMS", 0)
    df = spark.createDataFrame([(i, "abc " * 500) for i in range(40)], "id long, text string")
    rules = spark.createDataFrame([("abc", "x"), ("bc", "y"), ("zz", "z")], "term string, replacement string")
    made = []
    sizes = lambda d: d.select(F.count("*")).first()[0]
    join = type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, *a, **k: made.append(sizes(self)) or join(self, *a, **k))
    got = terms.replace_terms(df, "id", "text", rules)
    assert {r.text for r in got.collect()} == {"x " * 500} and got.count() == 40
    assert made == [2]  # each string of the only part once; there are 40,000 places


def test_pieces_of_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(terms, "PIECE_BYTES", 1000)
    texts = ["a" * n for n in (10, 2000, 0, 400, 400, 400, 5000)] + [None]
    pieces = list(terms._pieces(pa.RecordBatch.from_pydict({"t": texts}), "t"))
    assert [t for p in pieces for t in p.column("t").to_pylist()] == texts and len(pieces) > 3


def test_spans_without_overlaps(spark):
    rnd = random.Random(9)
    spans = sorted({(k, a, a + rnd.randint(1, 9), rnd.choice("xyz")) for k in range(6) for a in rnd.choices(range(80), k=40)})
    df = spark.createDataFrame(spans, "k int, start int, end int, t string")
    for first, order in (("leftmost", lambda s: (s[1], s[1] - s[2], s[2], s[3])), ("longest", lambda s: (s[1] - s[2], s[1], s[2], s[3]))):
        kept = []
        for s in sorted(spans, key=lambda s: (s[0], *order(s))):
            if all(s[0] != t[0] or s[2] <= t[1] or t[2] <= s[1] for t in kept):
                kept.append(s)
        assert sorted(map(tuple, terms.select_spans(df, "k", first).collect())) == sorted(kept)


def alike(a, b):
    a, b = a.lower(), b.lower()
    return a == b or (abs(len(a) - len(b)) <= 2 and len(b) > 3 and sum(x == y for x, y in zip(a, b, strict=False)) / max(min(len(a), len(b)), 1) >= 0.75)


def test_fuzzy_spans(spark):
    rnd = random.Random(4)
    words = ["Anna", "anno", "Berta", "Bertha", "of", "smith", "Smyth", "x"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))) for i in range(30)] + [(99, None)]
    names = ["anna smith", "smith", "berta of Smith", "of", "anna  smith berta", ""]
    df = spark.createDataFrame(docs, "id int, t string")
    got = terms.fuzzy_spans(terms.keyed_words(df, "id", "t"), "id", spark.createDataFrame([(n,) for n in names], "term string"))
    want = []
    for i, t in docs:
        w = (t or "").split()
        found = [(-len(n.split()), p, p + len(n.split()), n) for n in names if n for p in range(len(w) - len(n.split()) + 1) if all(map(alike, w[p:], n.lower().split()))]
        kept = []
        for _, a, b, n in sorted(found):
            if all(b <= c or d <= a for c, d, _ in kept):
                kept.append((a, b, n))
        want += [(i, *k) for k in kept]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


def plain_spans(tokens, names, first):
    """tokens: of one text, by place."""
    found = [(p, p + len(w), n) for n in names if (w := n.lower().split()) for p in tokens if all(p + j in tokens and alike(tokens[p + j], x) for j, x in enumerate(w))]
    kept = []
    for a, b, n in sorted(found, key=lambda s: (s[0], s[0] - s[1], s[2]) if first == "leftmost" else (s[0] - s[1], s[0], s[2])):
        if all(b <= c or d <= a for c, d, _ in kept):
            kept.append((a, b, n))
    return kept


@pytest.mark.parametrize("most", [terms.FUZZY_PAIRS, 0])
def test_fuzzy_spans_of_texts(spark, monkeypatch, most):
    for name, value in (("FUZZY_PAIRS", most), ("PART_WORDS", 100), ("PIECE_WORDS", 40), ("HELD_PLACES", 3)):
        monkeypatch.setattr(terms, name, value)
    rnd = random.Random(11)
    words = ["Anna", "anno", "Berta", "Bertha", "of", "smith", "Smyth", "smiths", "x", "unknown"]
    docs = [(i, " - ".join(rnd.choices(words, k=rnd.randint(0, 25)))) for i in range(60)] + [(98, ""), (99, None)]
    names = ["anna smith", "Anna smith", "smith", "berta of Smith", "of", "anna  smith berta", "", None, "smith smith smith", "of none", "x x", "anna of smith of anna"]
    df, table = spark.createDataFrame(docs, "id int, t string").repartition(3), spark.createDataFrame([(n,) for n in names], "term string")
    gaps = [(i, p * 3 // 2, w) for i, t in docs for p, w in enumerate((t or "").split(" - ")) if w]
    for first in ("longest", "leftmost"):
        want = [(i, *k) for i, t in docs for k in plain_spans(dict(enumerate(filter(None, (t or "").split(" - ")))), filter(None, names), first)]
        got = terms.fuzzy_text_spans(df, "id", "t", table, first=first)
        assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100 and any(len(k[3].split()) > 2 for k in want)
        want = [(i, *k) for i, _ in docs for k in plain_spans({p: w for j, p, w in gaps if j == i}, filter(None, names), first)]
        got = terms.fuzzy_spans(spark.createDataFrame(gaps, "id int, pos long, token string").repartition(3), "id", table, first=first)
        assert sorted(map(tuple, got.collect())) == sorted(want) and dict(got.dtypes)["start"] == "bigint"
    for some, other in ((df.limit(0), table), (df, table.limit(0)), (df, spark.createDataFrame([("nowhere",)], "term string"))):
        assert terms.fuzzy_text_spans(some, "id", "t", other).count() == 0


def test_words_of_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, "anna smith of berta " * 50) for i in range(20)], "id int, t string")
    got = terms.fuzzy_text_spans(df, "id", "t", spark.createDataFrame([("anne smith",), ("of",)], "term string"))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert got.count() == 2000 and "MapInArrow" in plan and not any(x in plan for x in ("Exchange", "Join", "Aggregate"))


def test_fuzzy_pairs_are_all_pairs(spark):
    rnd = random.Random(7)
    tokens, parts = ({"".join(rnd.choices("aAb", k=rnd.randint(1, 9))) for _ in range(n)} for n in (400, 150))
    parts = {p.lower() for p in parts}
    got = alias.fuzzy_tag(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(p,) for p in parts], "term string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, p) for t in tokens for p in parts if alike(t, p))


def test_names_in_records_by_table(spark):
    known = spark.createDataFrame([("Ann", "Q"), ("bob+1", "W"), ("bob+1", "Z")], "entity string, alias string")
    rows = [("lin=pn|Ann, bob%2B1 ,C,|st||", "lin=pn|Q,W,C,|st||"), ("https://x/?lin=pn%7CANN%2CBob%2B1%2C%2Cd%7Cst%7C", "https://x/?lin=pn%7CQ%2CW%2C%2Cd%7Cst%7C"), ("pn|ann|", "pn|Q|"), ("no names", "no names"), (None, None), ("", ""), ("open|ann|", "open|ann|")]
    df = spark.createDataFrame([(i, r, "keep") for i, (r, _) in enumerate(rows)], "id long, r string, alias string").repartition(2)
    got = terms.anonymize_records(df, "id", "r", known)
    assert got.columns == df.columns and {r.id: r.r for r in got.collect()} == {i: w for i, (_, w) in enumerate(rows)}


def test_partitions_of_records_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(terms, "PART_RECORDS", 100)
    df = spark.range(1200).selectExpr("id", "concat('pn|ann,x', id, '|') as r")
    known = spark.createDataFrame([("ann", "Q")], "entity string, alias string")
    got = terms.anonymize_records(df, "id", "r", known)
    assert got.rdd.getNumPartitions() == 12 and {r.r for r in got.collect()} == {f"pn|Q,x{i}|" for i in range(1200)}


def test_map_values_by_table(spark):
    known = spark.createDataFrame([(1, "x?n=a%2Bb&ann"), (2, None)], "id long, target string")
    names = {"a+b": "P+", "ann": "Q"}
    table = spark.createDataFrame(list(names.items()), "entity string, alias string")
    for aliases in (names, table):
        assert {r.id: r.target for r in alias.rewrite_map_values(known, aliases, key="id").collect()} == {1: "x?n=P%2B&Q", 2: None}
