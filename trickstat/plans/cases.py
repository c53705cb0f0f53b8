"""Queries over a case's sources and sinks: orders stand for records and report lines, line items for plays and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as forms
from ..operators import alias, play, report
from ..sources import records
from .tables import table
from .texts import TEXT_RULES, _replaced

RANKS = "23456789TJQKA"


def _card(n: Column) -> Column:
    return F.concat(F.substring(F.lit("SHDC"), (n % 4 + 1).cast("int"), F.lit(1)), F.substring(F.lit(RANKS), (n % 13 + 1).cast("int"), F.lit(1)))


def _cardplay(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.concat(F.concat_ws(" ", *(_card(k + i) for i in range(4))), F.lit("| |"), F.concat_ws("  ", _card(k + 5), _card(k * 3)))
    return table(spark, sf_dir, "orders").select(k.alias("board"), text.alias("cardplay"))


def decode_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.explode_plays(_cardplay(spark, sf_dir))


def encode_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.encode_plays(decode_plays(spark, sf_dir), "board")


def enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", F.lit("old").alias("lin_url"))
    lookup = table(spark, sf_dir, "lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("row_id"), F.col("l_linestatus").alias("cardplay"), F.col("l_returnflag").alias("lin_url"))
    return report.enrich_records(rows, lookup)


def scored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey")
    items = table(spark, sf_dir, "lineitem").where("l_linenumber > 3")
    seat = lambda i: F.col("l_linenumber") % 4 == i
    columns = {f"{what}_{s}": F.count_if(seat(i) & cond) for i, s in enumerate("nesw") for what, cond in (("plays", F.lit(True)), ("errors", F.col("l_quantity") > 25))}
    columns |= {"lead_error": F.max(F.col("l_quantity") > 40), "cost": F.sum(F.col("l_quantity").cast("long")), "level": F.min("l_linenumber"), "claimed": F.max("l_linenumber")}
    return report.scored_table(rows, items.groupBy(F.col("l_orderkey").alias("row_id")).agg(*(c.alias(n) for n, c in columns.items())))


def trick_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ply = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("board"), ply.alias("ply"), (F.col("l_suppkey") % 4).alias("seat"), _card(F.col("l_partkey")).alias("card"), (F.col("l_suppkey") % 3).cast("long").alias("cost"))
    return play.trick_listing(rows)


def declarer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    n, k = F.col("l_linenumber"), F.col("l_suppkey")
    own = forms.is_declaring(k, F.col("l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", forms.declarer_level(n, 13 - n, k % (14 - n), own).cast("long").alias("level"))


def case_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 7 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("id"), F.when(k % 5 == 0, "soon").otherwise(F.col("o_orderdate").cast("timestamp").cast("string")).alias("event_time"), "o_custkey")
    boards, analysis, hotspots = report.case_tables(rows, rows.where("o_custkey % 2 = 0").select("id", "o_custkey"), rows.select("id"))
    named = lambda df, name: df.select("id").withColumn("of", F.lit(name)).withColumn("event_time", F.lit(None).cast("timestamp"))
    out = boards.select("id", F.lit("boards").alias("of"), "event_time").unionByName(named(analysis, "analysis")).unionByName(named(hotspots, "hotspots"))
    return out.withColumn("event_time", F.col("event_time").cast("string"))


def board_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), k).alias("Doc_Board"), F.when(k % 6 == 0, "none").otherwise(F.col("o_custkey").cast("string")).alias("Dataset_Board_ID"), F.concat(F.lit("http://x/"), k).alias("Anon_LIN_URL"), F.col("o_orderstatus").alias("Fingerprint"))
    return records.board_map(rows)


def extra_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.extra_map(table(spark, sf_dir, "pages").withColumn("other", F.concat("url", F.lit("/"))), "other", "page_id")


def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("target"))
    rules = spark.createDataFrame(list(TEXT_RULES.items()), "entity string, alias string")
    return alias.rewrite_map_values(known, rules, key="doc_id")


def alias_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias.alias_lines(table(spark, sf_dir, "customer").select(F.lower("c_name").alias("entity"), F.concat(F.lit("Player "), "c_custkey").alias("alias")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.when(F.col("o_orderkey") % 3 == 0, "Hit").otherwise("Miss")
    sub = F.when(F.col("o_orderkey") % 4 == 0, " very late").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", hit.alias("hit"), sub.alias("sub"), F.concat(F.lit(" 3"), F.col("o_orderstatus")).alias("contract"), F.concat(F.lit(" Contract: 3"), F.col("o_orderstatus"), F.lit("  Lead: S4  "), F.col("o_orderdate").cast("date").cast("string")).alias("tail"))


def token_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("  "), "o_orderkey", F.lit(".  Lead"), "sub", F.lit(" "), "hit", "tail")
    return records.hotspots(_lines(spark, sf_dir).select(line.alias("line")), layout="tokens")


def line_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    key = F.when(k % 2 == 0, F.concat(k, F.lit(" Ann https://t.co/"), k)).otherwise(F.concat(F.lit("https://t.co/"), k, F.lit(" Bob")))
    line = F.concat(F.lit(" "), k, F.lit(". Opening Lead "), "hit", "sub", "tail", F.lit("  "), key, F.when(k % 5 == 0, " and more").otherwise(""))
    return records.hotspots(_lines(spark, sf_dir).select(line.alias("line"))).withColumn("date", F.col("date").cast("string"))


def hotspot_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("."), F.col("o_orderkey") % 9)).otherwise(""), F.lit(". Lead"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), text.alias("text"))
    return report.with_ordinal(rows, "text", "day", "o_orderkey")


def call_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, contracts, trumps and hands of texts made from orders."""
    k = F.col("o_orderkey")
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    calls = F.array(F.lit("p"), pick("1N!", "2s", "p"), pick("p", "d", "X", "p", "p"), pick("r", "p"))
    hand = F.concat(F.lit("S-"), pick("K85", "A"), F.lit(" H-873 D-"), pick("Q75", "T", "JT"), F.lit(" C-K3"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        forms.norm_call(pick("p", "d", "r", "1N", "2s!", "7n")).alias("call"),
        forms.norm_contract(pick("3NTS", "4Hx", "2S", "6Dxx", "1CW")).alias("contract"),
        forms.trump_of(pick("3NTS", "4Hx", "2S", "6Dxx", "Pass")).alias("trump"),
        forms.contract_of(calls).alias("auction"),
        forms.hand_to_dots(hand).alias("dots"),
        forms.suit_cards(hand, "D").alias("diamonds"),
        F.array_join(forms.cards_of(pick("S23HA", "DTC4", "")), " ").alias("cards"),
        play.seat_add(pick("N", "E", "S", "W", "x"), 3).alias("seat"),
        forms.vulnerability(pick("o", "N", "e", "b")).alias("vul"),
        forms.dealer(pick("1", "2", "3", "4")).alias("dealer"),
    )


QUERIES = {f.__name__: f for f in (decode_plays, encode_plays, enriched_records, scored_records, trick_listing, declarer_levels, case_tables, board_map, extra_map, map_values, alias_lines, token_hotspots, line_hotspots, hotspot_ordinals, call_forms)}


def _sql_card(n: str) -> str:
    return f"substr('SHDC', (({n}) % 4 + 1)::int, 1) || substr('{RANKS}', (({n}) % 13 + 1)::int, 1)"


def _pick(*words: str | None) -> str:
    return "[" + ", ".join("null" if w is None else f"'{w}'" for w in words) + f"][(k % {len(words)})::int + 1]"


_PLAYS = """p as (select o_orderkey as board, unnest([{'t': 0, 'p': 0, 'i': 0, 'n': o_orderkey}, {'t': 0, 'p': 1, 'i': 1, 'n': o_orderkey + 1}, {'t': 0, 'p': 2, 'i': 2, 'n': o_orderkey + 2},
    {'t': 0, 'p': 3, 'i': 3, 'n': o_orderkey + 3}, {'t': 1, 'p': 0, 'i': 4, 'n': o_orderkey + 5}, {'t': 1, 'p': 1, 'i': 5, 'n': o_orderkey * 3}]) as x from orders)"""
_SCORE = ", ".join(f"count(*) filter (l_linenumber % 4 = {i}{more})::varchar as {what}_{s}" for i, s in enumerate("nesw") for what, more in (("plays", ""), ("errors", " and l_quantity > 25")))
_L = """l as (select o_orderkey as k, case when o_orderkey % 3 = 0 then 'Hit' else 'Miss' end as hit, case when o_orderkey % 4 = 0 then 'very late' else '' end as sub, '3' || o_orderstatus as contract, o_orderdate::date::varchar as day from orders)"""
SQL = {
    "decode_plays": f"with {_PLAYS} select board, x.t as trick, x.p as pos, x.i as ply, substr('SHDC', (x.n % 4 + 1)::int, 1) as suit, (x.n % 13 + 2)::int as rank from p",
    "encode_plays": f"with {_PLAYS}, c as (select board, x.t as t, string_agg({_sql_card('x.n')}, ' ' order by x.p) as c from p group by all) select board, string_agg(c, '|' order by t) as cardplay from c group by 1",
    "enriched_records": "select o_orderkey as row_id, o_custkey, coalesce(l_linestatus, '') as cardplay, coalesce(l_returnflag, '') as lin_url from orders left join (select * from lineitem where l_linenumber = 2) on l_orderkey = o_orderkey",
    "scored_records": f"""with s as (select l_orderkey, {_SCORE}, (max(l_quantity) > 40)::varchar as lead_error, sum(l_quantity::bigint)::varchar as cost, min(l_linenumber)::varchar as level, max(l_linenumber)::varchar as claimed from lineitem where l_linenumber > 3 group by 1)
        select o_orderkey as row_id, o_custkey, {", ".join(f"coalesce({c}, '') as {c}" for c in report.SCORED)} from orders left join s on l_orderkey = o_orderkey""",
    "trick_listing": f"""with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as ply from lineitem)
        select l_orderkey as board, ply // 4 + 1 as trick, string_agg((l_suppkey % 4) || ':' || {_sql_card("l_partkey")}, ' ' order by ply) as cards,
        string_agg((l_suppkey % 3)::varchar, ',' order by ply) as costs, sum(l_suppkey % 3)::bigint as cost from l group by 1, 2""",
    "declarer_levels": "select l_orderkey, l_linenumber, (l_linenumber + case when (l_suppkey + l_partkey) % 2 = 0 then l_suppkey % (14 - l_linenumber) else 13 - l_linenumber - l_suppkey % (14 - l_linenumber) end)::bigint as level from lineitem",
    "case_tables": """with o as (select o_orderkey as id, o_custkey, case when o_orderkey % 5 <> 0 then strftime(o_orderdate::timestamp, '%Y-%m-%d %H:%M:%S') end as t from orders where o_orderkey % 7 <> 0)
        select id, 'boards' as of, t as event_time from o union all select id, 'analysis', null from o where o_custkey % 2 = 0 union all select id, 'hotspots', null from o""",
    "board_map": "select o_orderkey as doc_board, o_custkey as dataset_board, 'http://x/' || o_orderkey as link, o_orderstatus as fingerprint from orders where o_orderkey % 6 <> 0",
    "extra_map": "select lower(regexp_replace(url, '/+$', '')) as link_key, min(page_id::varchar) as board from pages group by 1",
    "map_values": _replaced("documents", "doc_id", "text", TEXT_RULES).replace("as text\n", "as target\n"),
    "alias_lines": "select 1::bigint as line_no, '# old=new' as line union all select 1 + row_number() over (order by lower(c_name)), lower(c_name) || '=Player ' || c_custkey from customer",
    "token_hotspots": f"with {_L} select k as ordinal, 'Lead' as category, sub as subclass, hit as outcome, contract, 'S4' as lead, day as date from l",
    "line_hotspots": f"""with {_L} select k as ordinal, 'Opening Lead' as category, hit as outcome, sub as subclass, contract, 'S4' as lead, day as date, day as date_text, case when k % 2 = 0 then k::varchar else 'https://t.co/' || k end as key,
        case when k % 2 = 0 then 'Ann' else 'Bob' end as player, case when k % 2 = 0 then 'https://t.co/' || k end as link from l""",
    "hotspot_ordinals": "select row_number() over (order by o_orderdate::date, o_orderkey) as ordinal, o_orderkey, o_orderdate::date::varchar as day, o_custkey || case when o_orderkey % 2 = 0 then '.' || (o_orderkey % 9) else '' end || '. Lead' as text, case when o_orderkey % 2 = 0 then (o_orderkey % 9)::int end as sub_index from orders",
    "call_forms": f"""with o as (select o_orderkey as k from orders),
        b as (select k, {_pick("1N", "2S", "")} as bid, {_pick("p", "d", "X", "p", "p")} as third, {_pick("r", "p")} as fourth from o)
        select k as o_orderkey, {_pick("pass", "X", "XX", "1NT", "2S", "7NT")} as call, {_pick("3NT", "4Hx", "2S", "6Dxx", "1C")} as contract, {_pick("NT", "H", "S", "D", "S")} as trump,
        case when bid = '' then 'Passed Out' else bid || case when fourth = 'r' then 'xx' when third in ('d', 'X') then 'x' else '' end end as auction,
        {_pick("K85", "A")} || '.873.' || {_pick("Q75", "T", "JT")} || '.K3' as dots, {_pick("Q75", "T", "JT")} as diamonds, {_pick("S2 S3 HA", "DT C4", "")} as cards,
        {_pick("W", "N", "E", "S", None)} as seat, {_pick("None", "NS", "EW", "Both")} as vul, {_pick("S", "W", "N", "E")} as dealer from b""",
}
