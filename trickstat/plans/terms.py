"""Queries over large lists of terms: words of documents and names of customers stand for the names that a case replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terms
from .tables import table

LENGTHS = (4, 5, 6, 7, 9)


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each benchmark text its first three words, two that overlap them, and one word of these."""
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) > 0)
    rows = table(spark, sf_dir, "benchmark").select(words.alias("w")).where(F.size("w") > 4)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    return rows.select(F.explode(F.array(part(1, 3), part(3, 2), part(4, 1))).alias("term"))


def fuzzy_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.fuzzy_text_spans(table(spark, sf_dir, "documents"), "doc_id", "text", _phrases(spark, sf_dir))


def fuzzy_phrases_leftmost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.fuzzy_text_spans(table(spark, sf_dir, "documents"), "doc_id", "text", _phrases(spark, sf_dir), first="leftmost")


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents' own words of some lengths, as terms."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[^a-z]+")).alias("term")).where(F.length("term").isin(*LENGTHS)).distinct()
    rows = words.where(F.substring(F.md5(F.col("term").cast("binary")), 1, 1) < "8")
    return rows.select("term", F.concat(F.lit("["), F.upper(F.substring("term", 1, 2)), F.lit("-"), F.length("term"), F.lit("]")).alias("replacement"))


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.replace_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", _many(spark, sf_dir))


def many_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.replace_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", _many(spark, sf_dir), "mask")


def many_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_spans(table(spark, sf_dir, "documents"), "doc_id", "text", _many(spark, sf_dir))


def records_by_alias_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    seat = lambda i: F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("o_custkey") + i).cast("string"), 9, "0"))
    plain = F.concat(F.lit("lin=pn|"), F.concat_ws(",", *(seat(i) for i in range(3)), F.lit("")), F.lit("|st||md|3|"))
    escaped = F.concat(F.lit("lin=pn%7C"), F.concat_ws("%2C", *(seat(i) for i in range(3)), F.lit("a%2Bb")), F.lit("%7Cst%7C%7C"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, plain).otherwise(escaped).alias("record"))
    aliases = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_name").alias("entity"), F.concat(F.lit("P"), "c_custkey").alias("alias"))
    return terms.anonymize_records(rows, "o_orderkey", "record", aliases.unionByName(spark.createDataFrame([("a+b", "AB")], "entity string, alias string")))


QUERIES = {f.__name__: f for f in (fuzzy_phrases, fuzzy_phrases_leftmost, many_rules, many_masks, many_spans, records_by_alias_table)}


def _fuzzy(order: str) -> str:
    return f"""with b as (select list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w <> '') as w from benchmark), c as (select w from b where len(w) > 4),
        t as (select distinct unnest([w[1] || ' ' || w[2] || ' ' || w[3], w[3] || ' ' || w[4], w[4]]) as term from c),
        p as (select term, len(x) as n, unnest(generate_series(0, len(x) - 1)) as j, unnest(x) as part from (select term, string_split(lower(term), ' ') as x from t)),
        d as (select doc_id, unnest(generate_series(0, len(x) - 1)) as pos, unnest(x) as token from (select doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w <> '') as x from documents) where len(x) > 0),
        a as (select token, part from (select distinct token, lower(token) as low from d) join (select distinct part from p) on abs(length(token) - length(part)) <= 2
            where low = part or (length(part) > 3 and list_sum(list_transform(range(1, least(length(low), length(part)) + 1), lambda i: (low[i] = part[i])::int)) / least(length(low), length(part)) >= 0.75)),
        s as (select doc_id, (pos - j)::int as start, (pos - j + n)::int as "end", term from d join a using (token) join p using (part) group by doc_id, pos - j, term, n having count(*) = n),
        f as (select doc_id, unnest(list_reduce(list_transform(list_sort(list({{'a': {order}, 'b': start, 'e': "end", 't': term}})), lambda s: [s]),
            lambda k, s: case when len(list_filter(k, lambda x: x.b < s[1].e and s[1].b < x.e)) > 0 then k else list_concat(k, s) end)) as s from s group by doc_id)
        select doc_id, s.b as start, s.e as "end", s.t as term from f"""


_KEPT = f"""with w as (select distinct term from (select unnest(regexp_split_to_array(text, '[^a-z]+')) as term from documents) where length(term) in {LENGTHS}),
    r as (select term, '[' || upper(term[:2]) || '-' || length(term) || ']' as new from w where md5(term)[1] < '8'),
    l as (select doc_id, unnest(generate_series(1, length(text))) as start, unnest(string_split(text, '')) as ch from documents where text <> ''),
    v as (select doc_id, start, string_agg(ch, '') over (partition by doc_id order by start rows between current row and {max(LENGTHS) - 1} following) as ahead from l),
    c as (select doc_id, start, n, left(ahead, n) as term from v, (select unnest({list(LENGTHS)}) as n) where length(ahead) >= n),
    m as (select doc_id, start - 1 as s, start - 1 + n as e, term, new from c join r using (term)),
    g as (select *, max(e) over (partition by doc_id order by s, e rows between unbounded preceding and 1 preceding) as far from m),
    h as (select *, count(*) filter (far <= s) over (partition by doc_id order by s, e rows between unbounded preceding and current row) as part from g),
    k as (select doc_id, unnest(list_reduce(list_transform(list_sort(list({{'s': s, 'l': -(e - s), 'e': e, 't': term, 'n': new}})), lambda x: [x]), lambda a, x: case when a[-1].e <= x[1].s then list_concat(a, x) else a end)) as x from h group by doc_id, part)"""


def _made(new: str) -> str:
    return f"""{_KEPT}, o as (select doc_id, x.s as s, x.e as e, x.t as t, x.n as n, coalesce(lag(x.e) over (partition by doc_id order by x.s), 0) as before from k),
        j as (select doc_id, string_agg(substr(text, before + 1, s - before) || {new}, '' order by s) as head, max(e) as last from o join documents using (doc_id) group by doc_id)
        select doc_id, case when head is null then text else head || substr(text, last + 1) end as text from documents left join j using (doc_id)"""


SQL = {
    "fuzzy_phrases": _fuzzy('start - "end"'),
    "fuzzy_phrases_leftmost": _fuzzy('start * 1000 + start - "end"'),
    "many_rules": _made("n"),
    "many_masks": _made("substr(rpad(n, length(t)::int, ' '), 1, length(t))"),
    "many_spans": f"{_KEPT} select doc_id, x.s::int as start, x.e::int as \"end\", x.t as found from k",
    "records_by_alias_table": """with o as (select o_orderkey, [case when k % 3 <> 0 and k <= m then 'P' || k else 'CUSTOMER#' || lpad(k::varchar, 9, '0') end for k in [o_custkey, o_custkey + 1, o_custkey + 2]] as n from orders, (select max(c_custkey) as m from customer))
        select o_orderkey, case when o_orderkey % 2 = 0 then 'lin=pn|' || array_to_string(n, ',') || ',|st||md|3|' else 'lin=pn%7C' || array_to_string(n, '%2C') || '%2CAB%7Cst%7C%7C' end as record from o""",
}
