"""Queries over keys: customers, suppliers, orders and pages stand for records, maps and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import links
from ..operators import keys
from .tables import table


def link_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", links.link_key(url, "example.com").alias("key"), links.to_https(url).alias("https"), links.percent_decode(url).alias("decoded"))


def first_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    first = keys.dedupe_by_key(rows, ["o_custkey"], F.col("o_orderkey"))
    last = keys.dedupe_by_key(rows, ["o_custkey"], F.col("o_orderkey"), "last")
    return first.select("o_custkey", F.col("o_orderkey").alias("first_key"), F.col("o_orderstatus").alias("first_status")).join(last.select("o_custkey", F.col("o_orderkey").alias("last_key"), F.col("o_orderstatus").alias("last_status")), "o_custkey")


def zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = keys.with_row_id(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    b = keys.with_row_id(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return keys.zip_rows(a, b)


def map_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return keys.union_override(first, second, "key")


def unmatched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return keys.unmatched(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    done = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return keys.pending(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), done, "c_custkey", F.col("o_orderstatus") != "F")


def two_stage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_custkey") % 30).cast("int").alias("n_nationkey"))
    direct = customer.where("c_acctbal > 5000").select("c_custkey", F.col("c_name").alias("name"))
    second = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return keys.resolve(rows, direct, "c_custkey", second, "n_nationkey", "name", "unknown").select("o_orderkey", "name")


def first_hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    first = keys.dedupe_by_key(rows, ["c_custkey"], F.col("o_orderkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(first, "c_custkey", "left")


def ordered_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys.first_n(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")


def count_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", (F.col("user_id") % 50).cast("string")).alias("key"), (F.dayofyear("ts") % 2).alias("odd"))
    side = lambda odd: rows.where(F.col("odd") == odd).groupBy("key").agg(F.count("*").alias("n"))
    return keys.diff_counts(side(0), side(1), "key", "n")


def hosts_by_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), "page_id")
    return keys.by_first_appearance(rows, "host", "page_id")


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.agg(F.countDistinct("user_id").alias("boards"), F.count("*").alias("hotspots"), F.count_if(F.col("event_type") == "error").alias("hits"), F.count_if(F.col("event_type") != "error").alias("misses"))


QUERIES = {f.__name__: f for f in (link_keys, first_last_wins, zip_rows, map_union, unmatched_keys, pending_rows, two_stage_lookup, first_hotspot, ordered_prefix, count_diff, hosts_by_appearance, report_summary)}

SQL = {
    "link_keys": r"""with p as (select page_id, url, lower(regexp_replace(trim(url), '/+$', '')) as l from pages)
        select page_id, case when contains(l, 'example.com/') then substr(l, strpos(l, 'example.com/') + 12) else l end as key, regexp_replace(trim(url), '^http://', 'https://') as https, url_decode(url) as decoded from p""",
    "first_last_wins": "select o_custkey, min(o_orderkey) as first_key, arg_min(o_orderstatus, o_orderkey) as first_status, max(o_orderkey) as last_key, arg_max(o_orderstatus, o_orderkey) as last_status from orders group by o_custkey",
    "zip_rows": "select row_id, c_custkey, c_name, s_suppkey, s_name from (select *, row_number() over (order by c_custkey) as row_id from customer) join (select *, row_number() over (order by s_suppkey) as row_id from supplier) using (row_id)",
    "map_union": "select coalesce(s_suppkey, c_custkey) as key, coalesce(s_name, c_name) as value from customer full join supplier on c_custkey = s_suppkey",
    "unmatched_keys": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)",
    "pending_rows": "select c_custkey, c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')",
    "two_stage_lookup": "select o_orderkey, coalesce(c_name, n_name, 'unknown') as name from orders left join (select * from customer where c_acctbal > 5000) on c_custkey = o_custkey left join nation on n_nationkey = o_custkey % 30",
    "first_hotspot": "select c_custkey, c_name, k as o_orderkey, p as o_orderpriority from customer left join (select o_custkey, min(o_orderkey) as k, arg_min(o_orderpriority, o_orderkey) as p from orders group by 1) on o_custkey = c_custkey",
    "ordered_prefix": "select o_orderkey, o_totalprice from orders order by o_orderkey limit 1000",
    "count_diff": """with r as (select event_type || '/' || (user_id % 50) as key, dayofyear(ts) % 2 as odd from events), a as (select key, count(*) as expected from r where odd = 0 group by 1), b as (select key, count(*) as actual from r where odd = 1 group by 1)
        select key, expected, actual, case when actual is null then 'missing' when expected is null then 'unexpected' when expected = actual then 'equal' when abs(expected - actual) = 1 then 'off by one' else 'different' end as verdict from a full join b using (key)""",
    "hosts_by_appearance": "select regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host, min(page_id) as first_at from pages group by 1",
    "report_summary": "select count(distinct user_id) as boards, count(*) as hotspots, count(*) filter (event_type = 'error') as hits, count(*) filter (event_type <> 'error') as misses from events",
}
