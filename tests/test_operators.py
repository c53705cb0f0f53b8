"""Operators on small invented inputs, against values worked out by hand or by a plain loop."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from trickstat.functions import hashing, links, stats, text
from trickstat.operators import alias, keys, play, rates, report
from trickstat.sources import records
from trickstat.streaming import incremental, tables


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_link_keys(spark):
    df = spark.createDataFrame([("https://tinyurl.com/AbC/",), (" http://x.org/P ",), ("a%7Cb+c%zz",)], "u string")
    got = df.select(links.link_key(F.col("u")).alias("k"), links.to_https(F.col("u")).alias("h"), links.percent_decode(F.col("u")).alias("d")).collect()
    assert got[0].k == "abc" and got[1].k == "http://x.org/p"
    assert got[1].h == "https://x.org/P" and got[2].d == "a|b+c%zz"


def test_record_parts(spark):
    df = spark.createDataFrame([("lin=pn%7Ca%2Cb%2Cc%2BQ%2Cd%7Cmd%7C3SAK,H2,D3%7C",), ("no",)], "r string")
    got = df.select(links.players_of(F.col("r")).alias("p"), links.deal_key(F.col("r")).alias("k")).collect()
    assert got[0].p == ["a", "b", "c+Q", "d"] and got[0].k == "3sak,h2,d3"
    assert got[1].p is None and got[1].k is None


def test_fnv_is_the_plain_loop(spark):
    words = ["", "a", "k1:Zoë", "Ünïcode 日本", "x" * 70]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    h = hashing.fnv1a64(F.col("w"))
    for w, r in zip(words, df.select(hashing.as_decimal(h).alias("h"), hashing.modulo(h, 263).alias("m"), hashing.divide_modulo(h, 263, 126).alias("d")).collect(), strict=True):
        x = 0xCBF29CE484222325
        for b in w.encode():
            x = (x ^ b) * 0x100000001B3 % 2**64
        assert (int(r.h), r.m, r.d) == (x, x % 263, x // 263 % 126)


def test_intervals(spark):
    r = spark.createDataFrame([(3, 40), (1, 10)], "e long, n long").select(stats.wilson_half_width(F.col("e"), F.col("n")).alias("w"), stats.wald_half_width(F.col("e"), F.col("n")).alias("a"), stats.normal_cdf(F.lit(-1.0)).alias("p")).collect()
    assert r[1].w is None and r[1].a is None
    assert r[0].a == pytest.approx(1.96 * math.sqrt(0.075 * 0.925 / 40) * 100)
    assert r[0].w == pytest.approx(12.4, abs=0.2) and r[0].p == pytest.approx(0.158655, abs=1e-6)


def test_seat_roles(spark):
    boards = spark.createDataFrame([("Ann", "Bob", "Cid", "Dee", "N", 5, 6, 7, 8, 1, 2, 3, 0), ("Ann", "Bob", "Cid", "Dee", "", 5, 6, 7, 8, 1, 2, 3, 0)], "player_n string, player_e string, player_s string, player_w string, declarer string, plays_n int, plays_e int, plays_s int, plays_w int, errors_n int, errors_e int, errors_s int, errors_w int")
    got = {r.entity: (r.deals, r.decl_plays, r.decl_errors, r.def_plays, r.def_errors) for r in rates.seat_role_stats(boards).collect()}
    assert got == {"ann": (1, 12, 4, 0, 0), "cid": (1, 0, 0, 0, 0), "bob": (1, 0, 0, 6, 2), "dee": (1, 0, 0, 8, 0)}


def test_partner_labels_are_the_greedy_ones(spark):
    rnd = random.Random(3)
    for _ in range(3):
        names = [f"p{i}" for i in range(8)]
        flagged = [(n, rnd.randint(5, 20), rnd.choice([0.01, 0.02, 0.03])) for n in names]
        pairs = [(a, b, rnd.randint(1, 15)) for i, a in enumerate(names) for b in names[i + 1 :] if rnd.random() < 0.5]
        label, number, deals = {}, 1, {n: d for n, d, _ in flagged}
        for n, _, _ in sorted(flagged, key=lambda x: (x[2], x[0])):
            if n in label:
                continue
            free = [(-c, b if a == n else a) for a, b, c in pairs if n in (a, b) and (b if a == n else a) not in label and c >= 0.6 * min(deals[a], deals[b])]
            if free:
                label[n] = label[min(free)[1]] = number
                number += 1
        got = rates.label_partners(spark.createDataFrame(flagged, "entity string, deals long, p double"), spark.createDataFrame(pairs or [("x", "y", 1)], "a string, b string, n long"))
        assert {r.entity: r.partner_no for r in got.collect() if r.partner_no} == label


@pytest.mark.parametrize("most", [rates.NODES, 0])
def test_pairs_of_partners_are_not_sorted_in_few_tasks(spark, monkeypatch, most):
    plans, stored = {}, tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and stored(df, name))
    monkeypatch.setattr(rates, "NODES", most)
    monkeypatch.setattr(rates, "EACH", 20)
    flagged = spark.createDataFrame([(i, 10, (i * 7 % 40) / 100) for i in range(40)], "entity long, deals long, p double")
    pairs = spark.createDataFrame([(a, b, (a * b) % 11) for a in range(40) for b in range(a + 1, 40)], "a long, b long, n long")
    got = {r.entity: r.partner_no for r in rates.label_partners(flagged, pairs, 0.9).collect()}
    free, want, number = set(range(40)), dict.fromkeys(range(40)), 1
    for x in sorted(range(40), key=lambda i: (i * 7 % 40, i)):
        best = min(((-(x * y % 11), y) for y in free if x in free and y != x and x * y % 11 >= 9), default=None)
        if best:
            want[x] = want[best[1]] = number
            number += 1
            free -= {x, best[1]}
    assert got == want and number > 5
    assert ("BroadcastHashJoin" in plans["edges"] and "SortMergeJoin" not in plans["edges"]) if most else "hashpartitioning(a" in plans["edges"] and ", 39)" in plans["edges"]


def test_rounds_of_partners_take_partitions_by_open_edges(spark, monkeypatch):
    plans, stored = [], tables.stored
    monkeypatch.setattr(tables, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or stored(df, name))
    monkeypatch.setattr(rates, "EACH", 20)
    flagged = spark.createDataFrame([(i, 10, i / 100) for i in range(40)], "entity long, deals long, p double")
    pairs = spark.createDataFrame([(a, b, 9) for a in range(40) for b in range(a + 5, 40, 5)], "a long, b long, n long")  # 5 groups of 8
    assert rates.partnered_share(rates.label_partners(flagged, pairs, 0.9)).first().asDict() == {"partnered": 40, "alone": 0}
    counts = [{int(n) for n in re.findall(r"hashpartitioning\([^)]*?, (\d+)\)", plan)} for name, plan in plans if name == "claims"]
    assert counts == [{14}, {8}, {3}, set()]  # 280, 150, 60 and 10 edges


def test_row_ids_and_maps(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "k long, v long").repartition(5)
    assert rows(keys.with_row_id(df, "k"), "row_id", "k") == sorted(((i + 1, i) for i in range(50)), key=str)
    assert rows(keys.dedupe_by_key(df.withColumn("g", F.col("k") % 3), ["g"], F.col("k"), "last"), "g", "k") == [(0, 48), (1, 49), (2, 47)]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z")], "k long, v string")
    assert rows(keys.union_override(a, b, "k"), "k", "v") == [(1, "x"), (2, "z")]
    assert rows(keys.diff_counts(a.select("k", F.lit(3).alias("n")), b.select("k", F.lit(4).alias("n")), "k", "n"), "k", "verdict") == [(1, "missing"), (2, "off by one")]


def test_tricks(spark):
    cards = [("S", 5), ("S", 9), ("H", 2), ("S", 7), ("D", 3), ("D", 3), ("D", 2), ("D", 1), ("C", 1)]
    plays = spark.createDataFrame([(1, i, s, r) for i, (s, r) in enumerate(cards)], "board long, ply long, suit string, rank int")
    won = play.trick_winners(plays, F.lit("H"), F.lit(2))
    assert rows(won, "trick", "leader", "winner", "size") == [(0, 2, 0, 4), (1, 0, 0, 4), (2, 0, 0, 1)]
    trace = spark.createDataFrame([(1, i, v) for i, v in enumerate([9, 9, 8, 8, 8, 8, 8, 9, 9])], "board long, ply long, level long")
    assert [r.cost for r in play.step_costs(trace, F.col("ply") % 2 == 0).orderBy("ply").collect()] == [0, 0, 1, 0, 0, 0, 0, 1, 0]
    coded = play.encode_costs(play.step_costs(trace, F.col("ply") % 2 == 0))
    assert coded.first().encoded == "T1:0,0,1,0|T2:0,0,0,1|T3:0"
    assert rows(play.decode_costs(coded), "trick", "pos", "cost")[2] == (0, 2, 1)


def test_pairing_nearest(spark):
    rnd = random.Random(1)
    for _ in range(4):
        kinds = [rnd.choice("aix") for _ in range(14)]
        df = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "g long, o long, k string")
        want, items, used = [], [i for i, k in enumerate(kinds) if k == "i"], set()
        last = -1
        for j, i in enumerate(items):
            own = [x for x in range(last + 1, i) if kinds[x] == "a"]
            nxt = items[j + 1] if j + 1 < len(items) else len(kinds)
            later = [x for x in range(i + 1, nxt) if kinds[x] == "a"]
            at = own[-1] if own else (later[0] if later and (j + 1 == len(items) or later[0] != later[-1]) else None)
            used.add(at)
            want.append((i, at))
            last = i
        assert rows(play.pair_nearest(df, "g", "o", "k", "i", "a"), "item_at", "anchor_at") == sorted(want, key=str)


def test_aliases_follow_the_loop(spark):
    names = [f"n{i}" for i in range(30)]
    firsts, lasts = ("A", "B"), ("X",)
    explicit = {"n3": "A_X_2", "n5": "B_X"}
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "entity string, seen long")
    got = {r.entity: r.alias for r in alias.assign_aliases(df, "k", spark.createDataFrame(list(explicit.items()), "entity string, alias string"), firsts, lasts).collect()}
    base = {r.entity: r.b for r in df.select("entity", alias.pseudonym(F.col("entity"), "k", firsts, lasts).alias("b")).collect()}
    used, want = set(explicit.values()), dict(explicit)
    for n in names:
        if n not in want:
            c, i = base[n], 2
            while c in used:
                c, i = f"{base[n]}_{i}", i + 1
            used.add(c)
            want[n] = c
    assert got == want
    with pytest.raises(ValueError):
        alias.anonymize_columns(df, ["absent"], df)


def test_text_replacement(spark):
    lines = ["adam      12", "adam 12", "the adam", "adam-eve    7", "Adam, eve x", ""]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    got = [r.s for r in df.select(alias.replace_aligned(F.col("s"), {"adam": "Bo", "eve": "Clarissa"}).alias("s")).collect()]
    assert got == ["Bo        12", "Bo   12", "the Bo", "Bo-Clarissa 7", "Bo, Clarissa x", ""]
    rules = {"ab": "x", "abc": "long one"}
    got = spark.createDataFrame([("zabcab",), (None,)], "s string").select(alias.replace_rules(F.col("s"), rules).alias("r"), alias.mask_fixed(F.col("s"), rules).alias("m")).collect()
    assert got[0].r == "zlong onex" and got[0].m == "zlonx " and got[1].r is None
    record = spark.createDataFrame([("lin=pn|Ann,bob%2B1,C,d|st||",)], "r string").select(alias.anonymize_record(F.col("r"), F.create_map(F.lit("ann"), F.lit("Q"), F.lit("bob+1"), F.lit("W"))).alias("r"))
    assert record.first().r == "lin=pn|Q,W,C,d|st||"


def test_forms(spark):
    df = spark.createDataFrame([(["1C", "p", "2H!", "D", "R", "p"],), (["p"],)], "c array<string>")
    assert [r.x for r in df.select(text.contract_of(F.col("c")).alias("x")).collect()] == ["2Hxx", "Passed Out"]
    r = spark.createDataFrame([("4SN", "S-K85 H- D-Q7 C-3")], "c string, h string").select(text.norm_contract(F.col("c")).alias("c"), text.trump_of(F.col("c")).alias("t"), text.hand_to_dots(F.col("h")).alias("d"), text.suit_cards(F.col("h"), "H").alias("v"), text.cards_of(F.lit("SK5H2")).alias("k")).first()
    assert (r.c, r.t, r.d, r.v, r.k) == ("4S", "S", "K85..Q7.3", "-", ["SK", "S5", "H2"])
    pairs = spark.createDataFrame([("Amber", "ambar"), ("abcd", "abzz"), ("kitten", "kittens")], "a string, b string")
    assert [r.m for r in pairs.select(text.fuzzy_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, True]


def test_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text('title line\nId,Name,Note\n1,Ann,"say "hi" now"\n2,Bob\n')
    got = records.read_records(spark, str(tmp_path / "r.csv")).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [(1, "1", "Ann", "say 'hi' now"), (2, "2", "Bob", None)]
    with pytest.raises(ValueError, match="tried Con, Contract"):
        records.resolve_columns(spark.range(1), any_of={"contract": ["Con", "Contract"]})
    lin = "pn|s1,w1,n1,e1|st||md|3SAKQH2,H34,D5|ah|Board 7|sv|b|mb|1C|an|clubs|mb|p!|pc|SA|pc|H3|pc|D5|pc|C2|pc|SK|mc|9|"
    boards, calls, plays = records.parse_records(spark.createDataFrame([(1, lin)], "id long, lin string"), "id", "lin")
    b = boards.first()
    assert (b.dealer, b.vul, b.player_n, b.claim, len(b.hand_e)) == ("N", "Both", "n1", 9, 52 - 7)
    assert rows(calls, "pos", "call", "alert", "note") == [(0, "1C", False, "clubs"), (1, "p", True, None)]
    assert rows(plays, "ply", "trick", "pos", "card")[4] == (4, 1, 0, "SK")
    lines = spark.createDataFrame([("1. Lead Hit sub Contract: 4S Lead: HK 2024-01-02 17 Ann http://a/b",), ("2. Signal Miss Contract: 3N Lead: S2 2024-01-03 https://tinyurl.com/x Bob",), ("---",)], "line string")
    assert rows(records.hotspots(lines), "ordinal", "category", "outcome", "key", "player") == [(1, "Lead", "Hit", "17", "Ann"), (2, "Signal", "Miss", "https://tinyurl.com/x", "Bob")]


def test_redaction_and_links(spark):
    conv = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "BEGIN", "", "x", "y", "END", "z"])], "c long, t long, s string")
    got = play.redact_spans(conv, "c", "t", "s", F.col("s") == "BEGIN", F.col("s") == "END", "[gone]").orderBy("t")
    assert [r.s for r in got.collect()] == ["a", "BEGIN", "", "[gone]", "", "END", "z"]
    pages = spark.createDataFrame([(1, '<a href="/p">1</a><a href="/q">2</a>'), (2, "none")], "id long, html string")
    known = spark.createDataFrame([("/p", "/x?a&b")], "link string, target string")
    got = {r.id: r.html for r in alias.rewrite_links(pages, "id", "html", r'href="(/[^"]*)"', known).collect()}
    assert got == {1: '<a href="/x?a&amp;b">1</a><a href="/q">2</a>', 2: "none"}


def test_scorer_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 0.0)], "k long, v double")
    done = incremental.apply_scorer(df, lambda r: {"inv": 1 / r["v"]}, "inv double")
    assert [(r.k, r.inv, r.status[:5]) for r in done.orderBy("k").collect()] == [(1, 0.5, "ok"), (2, None, "ERROR")]
    again = incremental.score_new(df, done, "k", lambda r: {"inv": -1.0}, "inv double")
    assert rows(again, "k", "inv") == [(1, 0.5), (2, -1.0)]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "i long").write.mode("append").parquet(source)
        incremental.ingest_stream(spark, spark.read.parquet(source).schema, source, sink, str(tmp_path / "cp"))
    assert sorted(r.i for r in spark.read.parquet(sink).collect()) == list(range(5))


def test_reports(spark):
    links_ = spark.createDataFrame([("https://tinyurl.com/A", "d1"), ("x", "d2"), ("y", None)], "link string, deal string")
    direct = spark.createDataFrame([("a", 7, "t7")], "link_key string, board int, target string")
    by_deal = spark.createDataFrame([("d2", 8, "t8")], "deal string, board int, target string")
    matched, index = report.link_tables(links_, direct, by_deal)
    assert rows(index, "link", "board", "source") == [("https://tinyurl.com/A", 7, "key"), ("x", 8, "deal"), ("y", 0, "")] and matched.count() == 2
    one = spark.range(1)
    hands = {s: F.array(F.lit(s + "1"), F.lit(s + "2")) for s in "NESW"}
    got = one.select(report.declarer_of(F.lit("S2"), hands).alias("d"), *(c.alias(s) for s, c in report.compass_hands(F.lit("S"), [F.lit("dec"), F.lit("lead"), F.lit("dummy"), F.lit("third")]).items()), report.commentary(Lead=F.lit("HK"), Bad_case=F.lit(None).cast("string"), n=F.lit(3)).alias("c"), report.trim_plays(F.lit("Lead"), F.array(F.lit("a"), F.lit("b"))).alias("t")).first()
    assert (got.d, got.N, got.E, got.S, got.W, got.c, got.t) == ("E", "dummy", "third", "dec", "lead", "Lead: HK\nn: 3", ["a"])
    seeded = report.seeded_aliases(spark, "s", 40).collect()
    assert len({r.alias for r in seeded}) == 40 and sorted(r.position for r in seeded) == list(range(40))
    boards = spark.createDataFrame([(1, 0, "")], "doc_board int, x int, y string").select("doc_board")
    assert rows(report.mapping_table(boards, spark.createDataFrame([(2, 5, "l")], "doc_board int, dataset_board int, link string")), "dataset_board", "link") == [(0, "")]
    table = spark.createDataFrame([(1, "Ann", "Bob"), (2, "bob", "")], "id int, n string, s string")
    text_ = spark.createDataFrame([("Ann   12",)], "line string")
    out, lines, aliases = report.anonymize_case(table, ["n", "s"], F.col("id"), "k", text_, "line", {"ann": "Q"})
    got = {r.id: (r.n, r.s) for r in out.collect()}
    assert got[1][0] == "Q" and got[1][1] == got[2][0] and got[2][1] == "" and lines.first().line == "Q     12" and aliases.count() == 2


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    lines = [f"{i},{'x' * (i % 37)}" if i % 5 else "" for i in range(4000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.txt").write_bytes("\r\n".join([*lines[:7], "é,end", "", ""]).encode())
    (tmp_path / "c.txt").write_bytes(b"")
    got = records.numbered_lines(spark, str(tmp_path), range_bytes=1000).collect()
    by = {f: [r.line for r in sorted((r for r in got if r.file.endswith(f)), key=lambda r: r.line_no)] for f in ("a.txt", "b.txt", "c.txt")}
    assert by == {"a.txt": lines, "b.txt": [*lines[:7], "é,end", ""], "c.txt": []}
    assert sorted(r.line_no for r in got if r.file.endswith("a.txt")) == list(range(1, 4001))


def test_made_names_are_distinct():
    assert len(set(alias.FIRST)) == len(alias.FIRST) == 240 and len(set(alias.LAST)) == len(alias.LAST) == 120
    assert not any("_" in n for n in alias.FIRST + alias.LAST)
