"""Queries over report tables: orders stand for hotspots, customers for boards, events for calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report
from . import rates, texts
from .tables import table


def _hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("board_id"), F.col("o_orderpriority").alias("category"), F.when(F.col("o_orderstatus") == "F", "Hit").otherwise("Miss").alias("outcome"))


def tagged_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("board_id"), "c_name")
    return report.report_tables(boards, _hotspots(spark, sf_dir), "board_id")["boards"]


def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.categories(_hotspots(spark, sf_dir))


def located_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    boards = rows.select(F.col("page_id").alias("board_id"), F.col("url").alias("link"), F.col("page_id").alias("row_id"))
    hot = rows.select(F.col("page_id").alias("ordinal"), F.when(F.col("page_id") % 3 == 0, (F.col("page_id") * 2).cast("string")).otherwise(F.col("url")).alias("key"))
    return report.locate_hotspots(hot, boards)


def lead_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    declarers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("board_id"), F.element_at(F.array(*map(F.lit, "NESW")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("declarer"))
    return report.lead_seat(_hotspots(spark, sf_dir), declarers, ("1-URGENT", "2-HIGH")).select("ordinal", "board_id", "category", "lead_seat")


def player_stats_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.player_stats_table(rates._users(spark, sf_dir))


def auction_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("call"), (F.col("value") > 80).alias("alert"), F.when(F.col("event_type") == "signup", F.lit("joined now")).alias("note")))).alias("calls"))
    return rows.select("user_id", report.auction_text(F.col("calls")).alias("auction"), report.explanations_text(F.col("calls")).alias("explanations"))


def links_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    lines = rows.select("page_id", F.concat(F.lit("see "), "url", F.lit(" and more")).alias("line"))
    known = rows.where("page_id % 2 = 0").groupBy(F.lower(F.regexp_replace("url", "/+$", "")).alias("link_key")).agg(F.min("page_id").alias("board"), F.min(F.concat(F.lit("x"), F.col("page_id"))).alias("target"))
    return report.replace_links_in_text(lines, "line", known, r"https?://\S+")


def anonymized_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("Agent "), F.col("c_nationkey")).alias("agent"))
    reports = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _, _ = report.anonymize_case(rows, ["c_name", "agent"], F.col("c_custkey"), "k2", reports, "text", texts.TERMS)
    return out


QUERIES = {f.__name__: f for f in (tagged_boards, report_categories, located_hotspots, lead_seats, player_stats_table, auction_texts, links_in_text, anonymized_case)}

_H = "h as (select o_orderkey as ordinal, o_custkey as board_id, o_orderpriority as category from orders)"
_RATED = ", ".join(f"round({c}, 4) as {c}" for c in ("decl_rate", "decl_ci", "def_rate", "def_ci", "diff"))
_COUNTERS = ", ".join(rates.rates.COUNTERS)

_GIVEN = ", ".join(f"'{v}'" for v in texts.TERMS.values())
_BASE = texts._pseudonym("'k2:' || entity", texts.alias.FIRST, texts.alias.LAST)

SQL = {
    "anonymized_case": f"""with n as (select lower(c_name) as entity, c_custkey * 2 as seen from customer union all select 'agent ' || c_nationkey, c_custkey * 2 + 1 from customer),
        one as (select entity, min(seen) as seen from n group by 1), rest as (select entity, seen, {_BASE} as base from one),
        num as (select *, row_number() over (partition by base order by seen, entity) as i from rest), size as (select base, count(*) as n from rest group by 1),
        free as (select base, unnest(list_filter(list_transform(range(1, n + 9), lambda i: case when i = 1 then base else base || '_' || i end), lambda c: c not in ({_GIVEN}))[:n]) as alias, unnest(range(1, n + 1)) as i from size),
        aliases as (select entity, alias from num join free using (base, i))
        select c_custkey, a.alias as c_name, b.alias as agent from customer join aliases a on a.entity = lower(c_name) join aliases b on b.entity = 'agent ' || c_nationkey""",
    "tagged_boards": f"with {_H} select c_custkey as board_id, c_name, ordinal, category from customer left join (select board_id, min(ordinal) as ordinal, arg_min(category, ordinal) as category from h group by 1) on board_id = c_custkey",
    "report_categories": f"with {_H} select category, min(ordinal) as first_at, count(*) as n from h group by 1",
    "located_hotspots": """with b as (select k, min(page_id) as board_row from (select page_id::varchar as k, page_id from pages union all select regexp_replace(trim(url), '^http://', 'https://'), page_id from pages) group by k),
        t as (select page_id as ordinal, case when page_id % 3 = 0 then (page_id * 2)::varchar else url end as key from pages)
        select ordinal, key, board_row from t left join b on k = regexp_replace(trim(key), '^http://', 'https://')""",
    "lead_seats": f"with {_H} select ordinal, board_id, category, case when category in ('1-URGENT', '2-HIGH') and c_custkey is not null then ['E', 'S', 'W', 'N'][(c_custkey % 4 + 1)::int] end as lead_seat from h left join (select * from customer where c_acctbal > 0) on c_custkey = board_id",
    "player_stats_table": f"with {rates._counters(rates._USERS)}, {rates._FIELD}, u as (select entity::varchar as entity, {_COUNTERS} from c union all select 'FIELD', {_COUNTERS} from f) select entity, {_COUNTERS}, {_RATED} from {rates._rated('u')}",
    "auction_texts": """select user_id, string_agg(event_type || case when value > 80 then '!' else '' end, '-' order by event_id) as auction,
        coalesce(string_agg('signup=joined+now', '|' order by event_id) filter (event_type = 'signup'), '') as explanations from events group by 1""",
    "links_in_text": """with k as (select lower(regexp_replace(url, '/+$', '')) as k, min(page_id) as board, min('x' || page_id) as target from pages where page_id % 2 = 0 group by 1)
        select page_id, 'see ' || coalesce(board::varchar, '[unknown]') || ' and more' || coalesce(' ' || target, '') as line from pages left join k on k = lower(regexp_replace(url, '/+$', ''))""",
}
