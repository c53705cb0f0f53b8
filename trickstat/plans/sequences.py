"""Queries over ordered steps: a user's events stand for the plays of a board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import play
from .tables import table

TYPES = ("view", "signup", "error", "click", "purchase")


def _plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ply = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("board"), ply.cast("long").alias("ply"), F.col("event_type").alias("suit"), F.col("value").alias("rank"), F.floor("value").alias("level"), "event_id")


def _winners(plays: DataFrame) -> DataFrame:
    return play.trick_winners(plays, F.lit("purchase"), F.col("board") % 4)


def trick_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.tricks_won(_winners(_plays(spark, sf_dir)), (F.col("board") + 3) % 4)


def seat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = _plays(spark, sf_dir)
    return play.seat_counts(play.with_seats(plays, _winners(plays)), F.col("suit") == "error")


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.step_costs(_plays(spark, sf_dir), F.col("ply") % 2 == 0)


def step_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costs(spark, sf_dir).select("board", "ply", "level", "cost")


def trick_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plays = _plays(spark, sf_dir)
    return play.trick_costs(plays, _winners(plays), (F.col("board") + 3) % 4)


def encode_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.encode_costs(_costs(spark, sf_dir))


def decode_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.decode_costs(encode_costs(spark, sf_dir))


def auction_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _plays(spark, sf_dir).groupBy("board").agg(F.array_sort(F.collect_list(F.struct("ply", "suit"))).alias("x"))
    return rows.select("board", play.lines_of(F.transform("x", lambda c: c["suit"])).alias("block"))


def fourth_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.collect_set(F.when(F.col("event_id") % 40 == k, F.col("suit")))
    rows = _plays(spark, sf_dir).groupBy("board").agg(part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))
    return rows.select("board", F.array_join(play.missing_of(F.array(*map(F.lit, TYPES)), "a", "b", "c"), ",").alias("rest"))


def auction_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    names = {s: F.concat(F.lit("P"), (key + i) % 97) for i, s in enumerate("nesw")}
    opener = F.concat(F.lit("p"), (key + F.col("o_orderkey") % 5) % 97)
    return table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in play.auction_roles(opener, names).items()))


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return play.pair_nearest(_plays(spark, sf_dir), "board", "ply", "suit", "purchase", "click")


def timeline_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return play.timeline_layout(rows, F.year("o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "year", "x", "y")


def subject_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("board"), (F.col("user_id") % 4).cast("int").alias("seat"), (F.col("event_type") == "error").cast("int").alias("e"))
    at = lambda s, c: F.coalesce(F.sum(F.when(F.col("seat") == s, c)), F.lit(0)).cast("long")
    boards = rows.groupBy("board").agg(*(at(s, F.lit(1)).alias(f"plays_{s}") for s in range(4)), *(at(s, F.col("e")).alias(f"errors_{s}") for s in range(4)))
    boards = boards.withColumns({f"player_{s}": F.concat(F.lit("u"), (F.col("board") + s) % 11) for s in range(4)})
    return play.subject_columns(boards, ["u1", "u7"])


def span_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return play.redact_spans(rows, "conv_id", "turn", "text", F.col("role") == "system", F.col("turn") % 3 == 2, "[redacted]")


QUERIES = {f.__name__: f for f in (trick_leaders, seat_counts, step_costs, trick_costs, encode_costs, decode_costs, auction_block, fourth_set, auction_roles, nearest_anchor, timeline_layout, subject_columns, span_redaction)}

_PLAYS = "p as (select user_id as board, row_number() over (partition by user_id order by ts, event_id) - 1 as ply, event_type as suit, value as rank, floor(value)::bigint as level, event_id from events)"
_TRICKS = f"""{_PLAYS}, t as (select *, ply // 4 as trick, ply % 4 as pos from p), l as (select *, first_value(suit) over (partition by board, trick order by pos) as led from t),
    r as (select *, row_number() over (partition by board, trick order by (case when suit = 'purchase' then 2 when suit = led then 1 else 0 end) desc, rank desc, pos) as i, count(*) over (partition by board, trick) as size from l),
    o as (select board, trick, size, case when size = 4 then pos else 0 end as won from r where i = 1),
    w as (select board, trick, size, ((board % 4) + coalesce(sum(won) over (partition by board order by trick rows between unbounded preceding and 1 preceding), 0)) % 4 as leader, won from o),
    ww as (select board, trick, size, leader::bigint as leader, ((leader + won) % 4)::bigint as winner from w)"""
_COSTS = f"""{_PLAYS}, c0 as (select *, coalesce(lag(level) over (partition by board order by ply) - level, 0) as ch from p), c as (select board, ply, level, greatest(case when ply % 2 = 0 then ch else -ch end, 0)::bigint as cost from c0)"""

SQL = {
    "trick_leaders": f"with {_TRICKS} select *, sum(case when (winner - (board + 3) % 4) % 2 = 0 and size = 4 then 1 else 0 end) over (partition by board order by trick)::bigint as won from ww",
    "seat_counts": f"with {_TRICKS}, s as (select t.board, t.ply, t.suit = 'error' as e, (ww.leader + t.pos) % 4 as seat from t join ww using (board, trick)) select board, "
    + ", ".join(f"count(*) filter (seat = {s}) as plays_{s}, count(*) filter (seat = {s} and e) as errors_{s}" for s in range(4))
    + ", bool_or(e) filter (ply = 0) as lead_error from s group by board",
    "step_costs": f"with {_COSTS} select * from c",
    "trick_costs": f"""with {_TRICKS}, b as (select *, lag(level) over (partition by board order by ply) as before from t),
        e as (select board, trick, max(before) filter (pos = 0) as s, arg_max(level, ply) as e from b group by all),
        j as (select *, (board + 3) % 4 as dec from e join ww using (board, trick) where size = 4 and e <> s)
        select board, trick, abs(e - s)::bigint as cost, case when e < s then dec when (leader - dec) % 2 <> 0 then leader else (leader + 1) % 4 end as seat from j""",
    "encode_costs": f"with {_COSTS}, g as (select board, ply // 4 as trick, string_agg(cost::varchar, ',' order by ply) as t from c group by all) select board, string_agg('T' || (trick + 1) || ':' || t, '|' order by trick) as encoded from g group by board",
    "decode_costs": f"with {_COSTS} select board, (ply // 4)::int as trick, (ply % 4)::int as pos, cost::int as cost from c",
    "auction_block": f"with {_PLAYS}, g as (select board, ply // 4 as k, string_agg(suit, ' ' order by ply) as l from p group by all) select board, string_agg(l, chr(10) order by k) as block from g group by board",
    "fourth_set": f"""with {_PLAYS}, h as (select board, list(distinct suit) filter (event_id % 40 < 3) as x from p group by board)
        select board, array_to_string(list_filter(['{"', '".join(TYPES)}'], lambda s: not list_contains(coalesce(x, []), s)), ',') as rest from h""",
    "auction_roles": """with o as (select o_orderkey, o_orderkey % 5 as k, [ 'P' || ((o_custkey + i) % 97) for i in [0, 1, 2, 3] ] as n from orders)
        select o_orderkey, case when k < 4 then n[(k + 1) % 4 + 1] end as overcaller, case when k < 4 then n[(k + 2) % 4 + 1] end as responder, case when k < 4 then n[(k + 3) % 4 + 1] end as advancer from o""",
    "nearest_anchor": f"""with {_PLAYS}, i as (select board, ply as item_at, lag(ply) over (partition by board order by ply) as prev, lead(ply) over (partition by board order by ply) as next from p where suit = 'purchase'),
        a as (select board, ply from p where suit = 'click'),
        x as (select i.*, (select max(ply) from a where a.board = i.board and ply < item_at and ply > coalesce(prev, -1)) as own,
            (select min(ply) from a where a.board = i.board and ply > item_at and ply < coalesce(next, 1000000000)) as later,
            (select max(ply) from a where a.board = i.board and ply > item_at and ply < coalesce(next, 1000000000)) as latest from i)
        select board, item_at, coalesce(own, case when next is null or later <> latest then later end) as anchor_at from x""",
    "timeline_layout": """with r as (select o_orderkey, year(o_orderdate) as year, row_number() over (partition by year(o_orderdate) order by o_orderdate, o_orderkey) - 1 as i from orders),
        s as (select year, ceil(count(*) / 150.0)::bigint + 2 as n from r group by year), b as (select year, coalesce(sum(n) over (order by year rows between unbounded preceding and 1 preceding), 0)::bigint as base from s)
        select o_orderkey, year, i % 150 as x, base + i // 150 as y from r join b using (year)""",
    "subject_columns": """with r as (select event_id % 500 as board, user_id % 4 as seat, (event_type = 'error')::int as e from events),
        g as (select board, """ + ", ".join(f"count(*) filter (seat = {s}) as p{s}, coalesce(sum(e) filter (seat = {s}), 0)::bigint as e{s}" for s in range(4)) + """ from r group by board)
        select board, """ + ", ".join(f"case {' '.join(f'when (board + {s}) % 11 = {u} then {w}{s}' + (f' + {w}{(s + 2) % 4}' if s % 2 == 0 else '') for s in range(4))} end as subject{i}_{n}" for i, u in ((1, 1), (2, 7)) for w, n in (("p", "plays"), ("e", "errors"))) + " from g",
    "span_redaction": """with m as (select *, case when role = 'system' then 'start' when turn % 3 = 2 then 'end' end as mark from conversations),
        w as (select *, last_value(mark ignore nulls) over s as l, count(*) filter (mark = 'start') over s as span from m window s as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)),
        i as (select *, coalesce(l, '') = 'start' and mark is null as ins from w), h as (select *, min(turn) filter (ins and text <> '') over (partition by conv_id, span) as head from i)
        select conv_id, turn, role, case when not ins then text when turn = head then '[redacted]' else '' end as text from h""",
}
