"""Queries over places and reasons, maps, sheets and exports. Users of events stand for players, orders for boards, pages for links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alias, keys, play, rates, report
from ..sources import records
from . import rates as plans
from .tables import table
from .texts import _pseudonym


def ranked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.most_deals(plans._users(spark, sf_dir)).select("entity", "deals", "place")


def flagged_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.flagged_by_p(rates.z_vs_field(plans._users(spark, sf_dir)), p=0.5).select("entity", F.round("p", 6).alias("p"), "place")


def sorted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = alias.extract_links(table(spark, sf_dir, "pages"), "page_id", "html", r'href="(/[^"]*)"')
    return keys.with_row_id(links.select("link").distinct(), "link")


def _pick(k: Column, *words: str) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))


def seat_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    seats = {f"plays_{s}": F.when(k % 4 == 0, 0).otherwise(k % 3) for s in "nesw"}
    return rates.skipped_boards(table(spark, sf_dir, "orders").select(_pick(k, "N", "e", " ", "South", "x").alias("declarer"), *(c.alias(n) for n, c in seats.items())))


def error_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("board", F.col("event_id") % 50)
    return rates.error_average(rows, "user_id", "board", F.col("event_type") == "view", (F.col("value") > 50).cast("int"))


def replaced_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("url")).alias("link"))
    known = rows.where("page_id % 2 = 0 and link <> ''").select(F.lower(F.regexp_replace("link", "/+$", "")).alias("link_key"), F.col("page_id").alias("board"))
    kept = report.replace_links(rows, "link", known).withColumnRenamed("link", "kept")
    return kept.join(report.replace_links(rows, "link", known, "[unknown]").withColumnRenamed("link", "marked"), "page_id")


def alias_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.concat(F.lit("n"), k, F.lit("=A=1, "), "c_mktsegment", F.lit(" = S"), k % 9, F.lit(",#x=y,, =z,w="))
    return records.alias_list(table(spark, sf_dir, "customer").select(text.alias("t")), "t")


def anonymized_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with three of the columns that hold names; two of them name the same customers."""
    k = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Cust "), k).alias("N"), F.concat(F.lit("CUST "), k + 1).alias("Dec name"), F.when(k % 3 == 0, "").otherwise("u7").alias("Leader"))
    return alias.anonymize_table(rows, "k3", order=F.col("o_orderkey"))[0].withColumnsRenamed({"N": "n", "Dec name": "declarer", "Leader": "leader"})


def timeline_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    shown = play.timeline_class(F.col("o_custkey") % 5 == 0, F.when(F.col("o_orderstatus") == "F", "Miss").otherwise("Hit"))
    return rows.groupBy(F.year("o_orderdate").alias("year"), shown.alias("shown")).agg(F.count("*").alias("n"))


def cardplay_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    lookup = table(spark, sf_dir, "orders").select(k.alias("board_id"), _pick(k, "S4 S2 S3 S5|HA", "", "DA").alias("cardplay"))
    boards = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("board_id"), F.col("c_custkey").alias("row_id"))
    return report.cardplay_table(lookup, boards)


def mapping_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 4 == 0, F.concat(F.lit("B"), k)).otherwise(F.concat(F.lit(" "), k)).alias("doc_board"), F.when(k % 5 == 0, "none").otherwise(F.col("o_custkey").cast("string")).alias("dataset_board"), F.concat(F.lit("https://x/?lin=pn%7C"), k).alias("link"))
    boards = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("board_id"), (F.col("c_custkey") + 1).alias("row_id"), F.col("c_name").alias("link"))
    own = report.mapping_sheet(rows, boards).select("doc_board", "doc_text", "link", "dataset_board", "dataset_text", "board_row", F.lit("own").alias("form"))
    return own.unionByName(report.mapping_sheet(rows, boards, anonymous=False).withColumn("form", F.lit("boards")))


def case_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.concat(F.lit("s_"), k).alias("south"), F.lit("west").alias("west"), F.lit("n_1_2").alias("north"), F.lit(None).cast("string").alias("east"),
        _pick(k, "N", "E", "S", "W").alias("dealer"), F.lit("EW").alias("vul"), F.lit("N:x").alias("deal"), F.lit("4S").alias("contract"), F.when(k % 3 > 0, F.array(*map(F.lit, ("1S", "pass", "4S", "pass", "pass", "pass")))).alias("calls"),
        _pick(k, "Lead", "Signal").alias("category"), _pick(k, "late", "", "early").alias("subclass"), F.lit("HK").alias("lead"), F.lit("Ann").alias("player"), _pick(k, "N", "E", "", "W").alias("declarer"),
    )
    return records.case_blocks(rows)


def seeded_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many aliases as there are nations, for each segment of customers as a seed."""
    n = table(spark, sf_dir, "nation").count()
    seeds = sorted(r[0] for r in table(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect())  # five
    out = None
    for seed in seeds:
        one = report.seeded_aliases(spark, seed, n).withColumn("seed", F.lit(seed))
        out = one if out is None else out.unionByName(one)
    return out


def _case(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat(F.lit("Agent "), F.col("c_nationkey")).alias("agent"))
    pages = table(spark, sf_dir, "pages")
    lines = pages.select("page_id", F.concat(F.lit("see "), "url", F.lit(" by Agent 7    12 the x")).alias("line"))
    known = pages.where("page_id % 2 = 0").groupBy(F.lower(F.regexp_replace("url", "/+$", "")).alias("link_key")).agg(F.min("page_id").alias("board"), F.min(F.concat(F.lit("x"), F.col("page_id"))).alias("target"))
    return report.anonymize_case(rows, ["c_name", "agent"], F.col("c_custkey"), "k2", lines, "line", {"agent 7": "Amber_Ash", "the": "T"}, known, r"https?://\S+")


def anonymized_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case(spark, sf_dir)[1]


def given_case_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case's aliases: those that were given, and whether each generated one is a name's own."""
    rows = _case(spark, sf_dir)[2]
    return rows.groupBy("generated").agg(F.count("*").alias("n"), F.countDistinct("alias").alias("n_aliases"), F.min(F.when(~F.col("generated"), F.col("alias"))).alias("given"))


QUERIES = {f.__name__: f for f in (ranked_entities, flagged_places, sorted_links, seat_skips, error_average, replaced_links, alias_list, anonymized_table, timeline_classes, cardplay_sheet, mapping_sheet, case_blocks, seeded_aliases, anonymized_reports, given_case_aliases)}


def _of(*words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][(k % {len(words)})::int + 1]"


def _numbered(names: str, key: str) -> str:
    """Aliases of names (entity, seen) under a key, of those with one base the n-th numbered n."""
    base = _pseudonym(f"'{key}:' || entity", alias.FIRST, alias.LAST)
    return f"""b as (select entity, seen, {base} as base from ({names})), aliases as (select entity, seen, case when i = 1 then base else base || '_' || i end as alias
        from (select *, row_number() over (partition by base order by seen, entity) as i from b))"""


_LINKS = "select distinct unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) as link from pages"
SQL = {
    "ranked_entities": f"with {plans._counters(plans._USERS)} select entity, deals, row_number() over (order by deals desc, entity) as place from c",
    "flagged_places": f"with {plans._counters(plans._USERS)}, {plans._FIELD}, {plans._TESTED} select entity, round(p, 6) as p, row_number() over (order by p, entity) as place from z1 where deals >= 50 and diff < -0.05 and p < 0.5",
    "sorted_links": f"select link, row_number() over (order by encode(link)) as row_id from ({_LINKS})",
    "seat_skips": f"""with o as (select o_orderkey as k from orders) select case {_of('a', 'a', 'no declarer', 'a', 'bad seat')} when 'a' then case when k % 4 = 0 or k % 3 = 0 then 'no plays' else 'eligible' end else {_of('a', 'a', 'no declarer', 'a', 'bad seat')} end as reason, count(*) as n from o group by 1""",
    "error_average": """with e as (select user_id, event_id % 50 as b, count(*) filter (value > 50) as n, min((event_type = 'view')::int) as d from events group by 1, 2)
        select user_id, sum(n)::bigint as total, count(*) filter (d = 0) as boards, round(sum(n) / nullif(count(*) filter (d = 0), 0), 2) as average from e group by 1""",
    "replaced_links": """with p as (select page_id, case when page_id % 7 = 0 then '' else url end as link, lower(regexp_replace(url, '/+$', '')) as key from pages), k as (select key, min(page_id::varchar) as b from p where page_id % 2 = 0 and link <> '' group by 1)
        select page_id, case when link = '' then '' else coalesce(b, link) end as kept, case when link = '' then '' else coalesce(b, '[unknown]') end as marked from p left join k using (key)""",
    "alias_list": """with p as (select 'n' || c_custkey as entity, 'A=1' as alias from customer union all select c_mktsegment, min('S' || c_custkey % 9) from customer group by 1)
        select entity, alias, row_number() over (order by length(entity) desc, entity) as place from p""",
    "anonymized_table": f"""with n as (select lower('Cust ' || o_custkey) as entity, o_orderkey * 3 as seen from orders union all select 'cust ' || (o_custkey + 1), o_orderkey * 3 + 1 from orders union all select 'u7', o_orderkey * 3 + 2 from orders where o_custkey % 3 <> 0),
        {_numbered("select entity, min(seen) as seen from n group by 1", "k3")}
        select o_orderkey, a.alias as n, b.alias as declarer, case when o_custkey % 3 = 0 then '' else c.alias end as leader from orders join aliases a on a.entity = 'cust ' || o_custkey join aliases b on b.entity = 'cust ' || (o_custkey + 1) left join aliases c on c.entity = 'u7'""",
    "timeline_classes": "select year(o_orderdate)::int as year, case when o_custkey % 5 = 0 then 'disclosed' when o_orderstatus = 'F' then 'miss' else 'background' end as shown, count(*) as n from orders group by 1, 2",
    "cardplay_sheet": f"""with l as (select o_orderkey as k, o_orderkey as board_id from orders), p as (select board_id, {_of("S4 S2 S3 S5|HA", "", "DA")} as cardplay from l)
        select board_id, cardplay, case when cardplay = 'DA' then 1 else 2 end as n_tricks, c_custkey as board_row from p left join customer on c_custkey * 2 = board_id where cardplay <> ''""",
    "mapping_sheet": """with o as (select o_orderkey as k, o_custkey as c from orders), m as (select case when k % 4 <> 0 then k end as doc_board, case when k % 4 = 0 then 'B' || k end as doc_text, 'https://x/?lin=pn|' || k as own, case when k % 5 <> 0 then c end as dataset_board, case when k % 5 = 0 then 'none' end as dataset_text from o),
        j as (select *, c_custkey + 1 as board_row from m left join (select * from customer where c_custkey % 3 = 0) on c_custkey = dataset_board)
        select doc_board, doc_text, own as link, dataset_board, dataset_text, board_row, 'own' as form from j union all select doc_board, doc_text, c_name, dataset_board, dataset_text, board_row, 'boards' from j""",
    "case_blocks": f"""with o as (select o_orderkey as k, row_number() over (order by o_orderkey) as board, o_orderdate::date::varchar as day from orders),
        v as (select *, {_of("N", "E", "S", "W")} as dealer, {_of("Lead", "Signal")} as category, {_of("late", "", "early")} as sub, {_of("E", "S", "", "N")} as seat from o)
        select k as id, board, '[Event ""]' || chr(10) || '[Site ""]' || chr(10) || '[Date "' || replace(day, '-', '.') || '"]' || chr(10) || '[Board "' || board || '"]' || chr(10) || '[West "west"]' || chr(10) || '[North "n..."]' || chr(10) || '[East ""]' || chr(10) || '[South "s..."]' || chr(10)
        || '[Dealer "' || dealer || '"]' || chr(10) || '[Vulnerable "EW"]' || chr(10) || '[Deal "N:x"]' || chr(10) || '[Scoring ""]' || chr(10) || '[Declarer ""]' || chr(10) || '[Contract "4S"]' || chr(10) || '[Result ""]' || chr(10)
        || case when k % 3 > 0 then '[Auction "' || dealer || '"]' || chr(10) || '1S pass 4S pass' || chr(10) || 'pass pass' || chr(10) else '' end || case when category = 'Lead' and seat <> '' then '[Play "' || seat || '"]' || chr(10) || 'HK - - -' || chr(10) else '' end
        || '{{<b>Hotspot:</b> ' || category || case when sub <> '' then ' / ' || sub else '' end || chr(10) || '<b>Contract:</b> 4S  <b>Lead:</b> HK  <b>Player:</b> Ann' || chr(10) || '<b>Date:</b> ' || day || '}}' || chr(10) as block from v""",
    "seeded_aliases": f"""with s as (select distinct c_mktsegment as seed from customer), n as (select seed, unnest(range((select count(*) from nation))) as position from s),
        b as (select seed, position, {_pseudonym("seed || ':' || lower(seed || '-' || position)", alias.FIRST, alias.LAST)} as base from n)
        select seed, position, case when i = 1 then base else base || '_' || i end as alias from (select *, row_number() over (partition by seed, base order by position) as i from b)""",
    "anonymized_reports": """with k as (select lower(regexp_replace(url, '/+$', '')) as k, min(page_id) as board, min('x' || page_id) as target from pages where page_id % 2 = 0 group by 1)
        select page_id, 'see ' || coalesce(board::varchar, '[unknown]') || ' by Amber_Ash  12 T   x' || coalesce(' ' || target, '') as line from pages left join k on k = lower(regexp_replace(url, '/+$', ''))""",
    "given_case_aliases": "with n as (select distinct n from (select lower(c_name) as n from customer union all select 'agent ' || c_nationkey from customer) where n <> 'agent 7') select true as generated, count(*) as n, count(*) as n_aliases, null::varchar as given from n union all select false, 1, 1, 'Amber_Ash' from customer where c_nationkey = 7 group by 2",
}
