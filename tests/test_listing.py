"""Places, skipped boards, averages, maps and exports on small invented inputs, nulls and ties among them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trickstat.operators import alias, play, rates, report
from trickstat.sources import records


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_places(spark):
    df = spark.createDataFrame([("b", 5, 0.2), ("a", 5, None), ("c", 9, 0.1), ("d", None, 0.2)], "entity string, deals int, p double")
    assert rows(rates.most_deals(df), "place", "entity") == [(1, "c"), (2, "a"), (3, "b"), (4, "d")]
    assert rows(rates.ranked(df, "p"), "place", "entity") == [(1, "c"), (2, "b"), (3, "d"), (4, "a")]
    assert rates.ranked(df, "p").columns == [*df.columns, "place"] and rates.most_deals(df.limit(0)).count() == 0


def test_skipped_boards_and_averages(spark):
    plays = ", ".join(f"plays_{s} int" for s in "nesw")
    df = spark.createDataFrame([("N", 1, 0, 0, 0), (None, 1, 1, 1, 1), (" ", 1, 1, 1, 1), ("x", 1, 1, 1, 1), ("s", 0, None, 0, 0), ("West", None, 3, None, None)], f"declarer string, {plays}")
    assert rows(rates.skipped_boards(df), "reason", "n") == [("bad seat", 1), ("eligible", 2), ("no declarer", 2), ("no plays", 1)]
    errors = spark.createDataFrame([("a", 1, 2, False), ("a", 1, 1, False), ("a", 2, 4, True), ("b", 1, 3, True)], "who string, board int, n int, dummy boolean")
    assert rows(rates.error_average(errors, "who", "board", F.col("dummy"), F.col("n")), "who", "total", "boards", "average") == [("a", 7, 1, 7.0), ("b", 3, 0, None)]


def test_links_in_columns(spark):
    known = spark.createDataFrame([("abc", 12), ("abc", 7)], "link_key string, board int")
    df = spark.createDataFrame([(1, "https://tinyurl.com/ABC/"), (2, "http://else"), (3, ""), (4, None)], "id int, my link string".replace("my link", "link"))
    assert rows(report.replace_links(df, "link", known), "id", "link") == [(1, "12"), (2, "http://else"), (3, ""), (4, None)]
    assert rows(report.replace_links(df, "link", known, "[unknown]"), "id", "link") == [(1, "12"), (2, "[unknown]"), (3, ""), (4, None)]


def test_alias_lists_and_tables(spark):
    df = spark.createDataFrame([("a=b, longer = c=d ,#x=y,=z,w=",), (None,), ("a=a",)], "t string")
    assert rows(records.alias_list(df, "t"), "place", "entity", "alias") == [(1, "longer", "c=d"), (2, "a", "a")]
    table = spark.createDataFrame([(1, "Ann", "bob", "x"), (2, "BOB", "", "y"), (3, None, "Ann", "z")], "id int, N string, Leader string, other string")
    out, aliases = alias.anonymize_table(table, "k", order=F.col("id"))
    got = {r.id: (r.N, r.Leader, r.other) for r in out.collect()}
    assert got[1][0] == got[3][1] and got[1][1] == got[2][0] and got[2][1] == "" and got[3][0] is None and got[2][2] == "y" and aliases.count() == 2
    with pytest.raises(ValueError, match="empty"):
        alias.anonymize_table(table, "")
    with pytest.raises(ValueError, match="none of the columns"):
        alias.anonymize_table(table.select("id"), "k")


def test_timeline(spark):
    df = spark.createDataFrame([(i, 2000 + i % 2, i % 3 == 0) for i in range(11)], "id int, y int, d boolean")
    got = {r.id: (r.x, r.y2) for r in play.timeline_layout(df.withColumnRenamed("y", "y0"), F.col("y0"), ["id"], cols=4).withColumnRenamed("y", "y2").collect()}
    assert [got[i] for i in (0, 2, 8, 10)] == [(0, 0), (1, 0), (0, 1), (1, 1)] and [got[i] for i in (1, 7, 9)] == [(0, 4), (3, 4), (0, 5)]
    shown = df.select(play.timeline_class(F.col("d"), F.when(F.col("id") % 2 == 0, "Miss")).alias("c"), "id")
    assert [r.c for r in shown.orderBy("id").limit(3).collect()] == ["disclosed", "background", "miss"]


def test_written_maps_and_scores(spark, tmp_path):
    pairs = spark.createDataFrame([("b", "2"), ("a", "1")], "entity string, alias string")
    alias.write_alias_map(pairs, str(tmp_path / "map"))
    lines = records.numbered_lines(spark, str(tmp_path / "map")).orderBy("file", "line_no")
    assert [r.line for r in lines.collect()] == ["# old=new", "a=1", "b=2"]
    assert rows(records.alias_pairs(lines), "entity", "alias") == [("a", "1"), ("b", "2")]
    (tmp_path / "b.csv").write_text("Doc_Board,Dataset_Board_ID,Anon_LIN_URL,Fingerprint\n 3,7,u,f\nx,1,,\n")
    assert rows(records.read_board_map(spark, str(tmp_path / "b.csv")), "doc_board", "dataset_board", "link") == [(3, 7, "u")]
    base = spark.createDataFrame([(1, "r1"), (2, "r2")], "row_id int, r string")
    scores = spark.createDataFrame([(1, 5)], "row_id int, cost int")
    report.write_scored(base, scores, str(tmp_path / "s"), ("cost",))
    assert rows(spark.read.csv(str(tmp_path / "s"), header=True), "row_id", "r", "cost") == [("1", "r1", "5"), ("2", "r2", None)]
    assert [r.t for r in base.select(report.has_term(F.col("r"), ["R1", "q"]).alias("t")).collect()] == [True, False]


def test_report_sheets(spark):
    boards = spark.createDataFrame([(7, 2, "u7"), (7, 1, "first")], "board_id long, row_id long, link string")
    lookup = spark.createDataFrame([(7, "SA S2|H3"), (8, "D2"), (9, None), (10, "")], "board_id long, cardplay string")
    assert rows(report.cardplay_table(lookup, boards), "board_id", "n_tricks", "board_row") == [(7, 2, 1), (8, 1, None)]
    map_ = spark.createDataFrame([(" 3", "7", "a%7Cb"), ("B4", "none", ""), (None, None, None)], "doc_board string, dataset_board string, link string")
    assert rows(report.mapping_sheet(map_, boards), "doc_board", "doc_text", "link", "board_row") == [(3, None, "a|b", 1), (None, "B4", None, None), (None, None, None, None)]
    assert [r.link for r in report.mapping_sheet(map_, boards, False).where("doc_board = 3").collect()] == ["first"]
    row = (5, None, "s_x", None, "n", "e", "N", "None", "N:..", "4S", None, "Signal", None, "HK", None, None)
    block = records.case_blocks(spark.createDataFrame([row], "id long, date date, south string, west string, north string, east string, dealer string, vul string, deal string, contract string, calls array<string>, category string, subclass string, lead string, player string, declarer string")).first().block
    assert '[Board "1"]' in block and '[South "s..."]' in block and '[West ""]' in block and "[Auction" not in block and "[Play" not in block and block.endswith("<b>Player:</b> }\n")
