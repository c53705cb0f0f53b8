"""Queries over what a case exchanges with others: game records, link indexes, maps, report texts, exports. Orders,
customers and pages stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links
from ..functions import text as forms
from ..operators import alias, rates, report
from ..sources import records
from .tables import table

DEALS = ("SAKQH2,H34,D5", "SJTDAK,C23HA,S9H9")
HELD = (("SA SK SQ H2", "H3 H4", "D5"), ("SJ ST DA DK", "C2 C3 HA", "S9 H9"))


def _pick(k: Column, *words: str) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))


def _game_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.lit("lin=pn|s"), "o_custkey", F.lit(",w"), k, F.lit(",n,e|st||md|"), _pick(k, "1", "2", "3", "4"), _pick(k, *DEALS), F.lit("|ah|Board "), k, F.lit("|sv|"), _pick(k, "o", "n", "e", "b"))
    text = F.concat(text, F.lit("|mb|1C|an|clubs|mb|"), _pick(k, "p!", "2s", "d"), F.lit("|mb|p|pc|sA|pc|H3|pc|D5|pc|C2|pc|SK|mc|"), k % 14, F.lit("|"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), text.alias("lin"))


def parsed_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _game_records(spark, sf_dir)
    boards = records.parse_records(rows, "id", "lin")[0]
    named = rows.select(F.col("id").alias("board_id"), F.array_join(links.players_of(F.col("lin")), ";").alias("players"), links.deal_key(F.col("lin")).alias("deal"))
    hands = {f"hand_{s}": F.array_join(f"hand_{s}", " ") for s in "swne"}
    return boards.withColumns(hands | {"board": forms.board_no(F.col("header"))}).join(named, "board_id")


def parsed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_records(_game_records(spark, sf_dir), "id", "lin")[1].withColumn("pos", F.col("pos").cast("long"))


def parsed_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parse_records(_game_records(spark, sf_dir), "id", "lin")[2].withColumns({c: F.col(c).cast("long") for c in ("ply", "trick", "pos")})


def link_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boards for each known key and for some deals: one row per link all the same."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    every = rows.select(F.concat(F.lit("https://tinyurl.com/L"), k, F.lit("/")).alias("link"), F.concat(F.lit("d"), "o_custkey").alias("deal"))
    direct = rows.where(k % 3 == 0).select(F.concat(F.lit("l"), k).alias("link_key"), F.explode(F.array(k + 1, k)).alias("board"), F.concat(F.lit("t"), k).alias("target"))
    by_deal = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("d"), "c_custkey").alias("deal"), F.explode(F.array("c_custkey", F.col("c_custkey") + 5)).alias("board"), F.col("c_name").alias("target"))
    return report.link_tables(every, direct, by_deal)[1].withColumn("board", F.col("board").cast("long"))


def seat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    seats = {}
    for i, s in enumerate("nesw"):
        seats |= {f"player_{s}": F.concat(F.lit("P"), k % 20 + 20 * i), f"plays_{s}": (k + i) % 14, f"errors_{s}": (k + i) % 14 % 3}
    return rates.seat_role_stats(table(spark, sf_dir, "orders").select(_pick(k, "N", "e", "South", " W", "").alias("declarer"), *(c.alias(n) for n, c in seats.items())))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    hands = {s: F.array(F.lit(f"c{2 * i}"), F.lit(f"c{2 * i + 1}")) for i, s in enumerate("NESW")}
    lead = F.concat(F.lit("c"), k % 9)
    declarer = report.declarer_of(lead, hands)
    at = report.compass_hands(declarer, [F.lit(x) for x in ("dec", "lead", "dummy", "third")])
    plays = F.array_join(report.trim_plays(_pick(k, "Lead", "Signal", "Opening Lead"), F.array(lead, F.lit("x"))), " ")
    said = report.commentary(Declarer=declarer, Played_first=lead, Note=F.when(k % 4 == 0, F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", declarer.alias("declarer"), *(at[s].alias(f"hand_{s.lower()}") for s in "NESW"), plays.alias("plays"), said.alias("said"))


def derived_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    old = rows.select(k.alias("row_id"), F.concat(F.lit("Name "), k % 40).alias("a"), F.concat(F.lit("X"), k % 7).alias("b"))
    new = rows.select(k.alias("row_id"), F.concat(F.lit("Alias "), k).alias("a"), F.concat(_pick(k, "x", "Y"), k % 7).alias("b"))
    return alias.derive_alias_map(old, new, ["a", "b"])


def derived_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.concat("url", F.lit("/")).alias("old"), F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("http://new/"), "page_id")).alias("new"))
    return report.derive_link_map(rows, rows, "old", "new")


def given_alias_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that were given, in their cases; generated ones stay out."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("ann mARY"), "c_custkey").alias("entity"), F.concat(F.lit("A"), "c_custkey").alias("alias"), (F.col("c_custkey") % 3 == 0).alias("generated"))
    return alias.case_variants(report.subject_map(rows).select("entity", "alias"))


def coerced_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("n/a "), k)).otherwise(F.concat(k, F.lit(".5"))).alias("rate"), F.col("o_orderdate").cast("date").cast("string").alias("day"))
    return report.coerce_cells(rows, ["rate"], ["day"])


def export_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return records.pbn_blocks(table(spark, sf_dir, "orders").select(k.alias("id"), k.alias("board"), _pick(k, "N", "E", "S", "W").alias("dealer"), F.lit(None).cast("string").alias("vul"), F.col("o_orderstatus").alias("deal"), F.lit("3NT").alias("contract"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("commentary")))


def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.when(k % 40 < 4, " Name   Detector").when(k % 40 > 30, "-----").otherwise(F.concat(_pick(k, "  name", "name", "other"), k % 13, F.lit("  x")))
    return records.subjects(table(spark, sf_dir, "orders").select((k % 3).alias("file"), k.alias("line_no"), line.alias("line")))


def alias_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    line = F.concat(_pick(k, "", "# ", "=", "  "), "c_name", _pick(k, "=", " = ", ""), F.lit("New "), k)
    return records.alias_pairs(table(spark, sf_dir, "customer").select(line.alias("line")))


def mapped_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("doc_board"), F.col("c_nationkey").cast("long").alias("dataset_board"), F.col("c_name").alias("link"))
    return report.mapping_table(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_board")), known)


QUERIES = {f.__name__: f for f in (parsed_boards, parsed_calls, parsed_plays, link_index, seat_roles, report_lines, derived_aliases, derived_links, given_alias_forms, coerced_cells, export_blocks, listed_names, alias_pairs, mapped_boards)}


def _of(k: str, *words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({k} % {len(words)})::int + 1]"


_DECK = "[" + ", ".join(f"'{c}'" for c in records.DECK) + "]"
_HANDS = [_of("k", *(h[i] for h in HELD)) for i in range(3)]
_SEATS = " union all ".join(f"select o_orderkey as k, {i} as seat, 'p' || (o_orderkey % 20 + {20 * i}) as name, (o_orderkey + {i}) % 14 as plays, (o_orderkey + {i}) % 14 % 3 as errors from orders" for i in range(4))
_SUM = lambda c, side: f"coalesce(sum({c}) filter ({side} and {c} is not null), 0)::bigint"

SQL = {
    "parsed_boards": f"""with o as (select o_orderkey as k, o_custkey as c from orders), h as (select *, {_HANDS[0]} as hs, {_HANDS[1]} as hw, {_HANDS[2]} as hn from o)
        select k as board_id, 'Board ' || k as header, {_of("k", "S", "W", "N", "E")} as dealer, {_of("k", "None", "NS", "EW", "Both")} as vul, 's' || c as player_s, 'w' || k as player_w, 'n' as player_n, 'e' as player_e,
        hs as hand_s, hw as hand_w, hn as hand_n, array_to_string(list_filter({_DECK}, lambda x: not list_contains(string_split(hs || ' ' || hw || ' ' || hn, ' '), x)), ' ') as hand_e,
        (k % 14)::int as claim, k::int as board, 's' || c || ';w' || k || ';n;e' as players, {_of("k", "1", "2", "3", "4")} || lower({_of("k", *DEALS)}) as deal from h""",
    "parsed_calls": f"""with c as (select o_orderkey as board_id, {_of("o_orderkey", "p!", "2s", "d")} as second, unnest([0, 1, 2]) as pos from orders)
        select board_id, pos::bigint as pos, case pos when 0 then '1C' when 1 then replace(second, '!', '') else 'p' end as call, pos = 1 and second = 'p!' as alert, case when pos = 0 then 'clubs' end as note from c""",
    "parsed_plays": "with p as (select o_orderkey as board_id, unnest(range(5)) as ply from orders) select board_id, ply, ply // 4 as trick, ply % 4 as pos, ['SA', 'H3', 'D5', 'C2', 'SK'][ply + 1] as card from p",
    "link_index": """select 'https://tinyurl.com/L' || o_orderkey || '/' as link, case when o_orderkey % 3 = 0 then o_orderkey when c_custkey is not null then c_custkey else 0 end as board,
        case when o_orderkey % 3 = 0 then 't' || o_orderkey else coalesce(c_name, '') end as target, case when o_orderkey % 3 = 0 then 'key' when c_custkey is not null then 'deal' else '' end as source
        from orders left join (select * from customer where c_custkey % 2 = 0) on c_custkey = o_custkey""",
    "seat_roles": f"""with s as ({_SEATS}), d as (select *, k % 5 as declarer, (seat - k % 5) % 2 = 0 as side from s where k % 5 < 4),
        w as (select case when side then 'p' || (k % 20 + 20 * declarer) else name end as entity, side, plays, errors, 0 as deals, 0 as a, 0 as b from d
            union all select name, side, null, null, 1, (seat = declarer)::int, (not side)::int from d)
        select entity, sum(deals)::bigint as deals, sum(a)::bigint as decl_deals, sum(b)::bigint as def_deals, {_SUM("plays", "side")} as decl_plays, {_SUM("errors", "side")} as decl_errors,
        {_SUM("plays", "not side")} as def_plays, {_SUM("errors", "not side")} as def_errors from w group by 1""",
    "report_lines": f"""with o as (select o_orderkey as k, o_orderstatus as s, case when o_orderkey % 9 < 8 then ((o_orderkey % 9) // 2 + 3) % 4 end as d from orders),
        n as (select *, ['N', 'E', 'S', 'W'][d + 1] as declarer, 'c' || k % 9 as lead from o)
        select k as o_orderkey, declarer, {", ".join(f"['dec', 'lead', 'dummy', 'third'][({i} - d + 4) % 4 + 1] as hand_{s}" for i, s in enumerate("nesw"))},
        case when k % 3 = 1 then '' else lead end as plays, coalesce('Declarer: ' || declarer || chr(10), '') || 'Played first: ' || lead || case when k % 4 = 0 then chr(10) || 'Note: ' || s else '' end as said from n""",
    "derived_aliases": """with p as (select c_custkey as r, 0 as i, 'name ' || c_custkey % 40 as entity, 'Alias ' || c_custkey as alias from customer union all select c_custkey, 1, 'x' || c_custkey % 7, 'Y' || c_custkey % 7 from customer where c_custkey % 2 = 1)
        select entity, arg_min(alias, r * 2 + i) as alias from p group by 1""",
    "derived_links": "select lower(regexp_replace(url, '/+$', '')) as link_key, arg_min('http://new/' || page_id, page_id) as target from pages where page_id % 5 <> 0 group by 1",
    "given_alias_forms": """with c as (select c_custkey as k from customer where c_custkey % 3 <> 0), f as (select k, unnest(['ann mARY', 'ann mary', 'ANN MARY', 'Ann Mary']) as n from c) select n || k as entity, 'A' || k as alias from f""",
    "coerced_cells": """with o as (select o_orderkey, case when o_orderkey % 3 = 0 then 'n/a ' || o_orderkey else o_orderkey || '.5' end as rate_text, replace(o_orderdate::date::varchar, '-', '.') as day from orders)
        select o_orderkey, try_cast(rate_text as double) as rate, day, rate_text from o""",
    "export_blocks": f"""select o_orderkey as id, '[Board "' || o_orderkey || '"]' || chr(10) || '[Dealer "' || {_of("o_orderkey", "N", "E", "S", "W")} || '"]' || chr(10) || '[Vulnerable ""]' || chr(10) || '[Deal "' || o_orderstatus || '"]' || chr(10)
        || '[Contract "3NT"]' || chr(10) || '{{' || case when o_orderkey % 2 = 0 then o_orderpriority else '' end || '}}' || chr(10) as block from orders""",
    "listed_names": f"""with l as (select o_orderkey % 3 as f, o_orderkey as n, case when o_orderkey % 40 < 4 then 'start' when o_orderkey % 40 > 30 then 'end' end as mark, {_of("o_orderkey", "name", "name", "other")} || o_orderkey % 13 as name from orders),
        m as (select *, last_value(mark ignore nulls) over (partition by f order by n) as last from l) select name, min(n) as first_at from m where last = 'start' and mark is null group by 1""",
    "alias_pairs": f"""with c as (select c_name as n, c_custkey as k, c_custkey % 4 as a, c_custkey % 3 as b from customer)
        select n as entity, 'New ' || k as alias from c where a in (0, 3) and b < 2""",
    "mapped_boards": "select o_orderkey, o_custkey as doc_board, coalesce(c_nationkey, 0)::bigint as dataset_board, coalesce(c_name, '') as link from orders left join (select * from customer where c_custkey % 3 = 0) on c_custkey = o_custkey",
}
