"""Queries over names, links and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import text as forms
from ..operators import alias
from .tables import table

FIRSTS, LASTS = alias.FIRST[:5], alias.LAST[:3]
TERMS = {"the": "Amber_Ash", "that": "Dale", "und": "Iris_Hill", "que": "Fern", "les": "Q"}
TEXT_RULES = {"the": "[a]", "then": "[b]", "der": "[c]", "de": "[d]", "Released under the MIT License.": "[license]"}
LINK = r'href="(/[^"]*)"'


def fnv_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.as_decimal(hashing.fnv1a64(F.col("c_name"))).cast("string").alias("hash"))


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", alias.pseudonym(F.lower("c_name"), "k1").alias("alias"))


def _aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("entity"), F.col("c_custkey").alias("seen"))
    explicit = table(spark, sf_dir, "customer").where("c_custkey % 100 = 7").select(F.col("c_name").alias("entity"), F.concat(F.lit("Amber_Ash_"), F.col("c_custkey")).alias("alias"))
    return alias.assign_aliases(names, "k1", explicit, FIRSTS, LASTS)


def alias_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aliases(spark, sf_dir)


def alias_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aliases(spark, sf_dir).agg(F.count("*").alias("n_names"), F.count_if(~F.col("generated")).alias("explicit"), F.count_if("generated").alias("generated"), F.countDistinct("alias").alias("n_aliases"))


def anonymize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("player"))
    return alias.anonymize_columns(orders, ["player", "other"], _aliases(spark, sf_dir))


def anonymize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    seat = lambda i: F.concat(F.lit("u"), (F.col("event_id") + i) % 5)
    record = F.concat(F.lit("lin=pn|"), F.concat_ws(",", *(seat(i) for i in range(4))), F.lit("|st||md|3|"))
    map_ = F.create_map(F.lit("u0"), F.lit("Amber"), F.lit("u1"), F.lit("Birch"), F.lit("u2"), F.lit("Cedar"))
    return table(spark, sf_dir, "events").select("event_id", alias.anonymize_record(record, map_).alias("record"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))


def aligned_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line", alias.replace_aligned(F.col("t"), TERMS).alias("t"))


def replace_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", alias.replace_rules(F.col("text"), TEXT_RULES).alias("text"))


def mask_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", alias.mask_fixed(F.col("text"), TEXT_RULES).alias("text"))


def redact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", alias.redact_terms(F.col("text"), ["the", "and"], r"[A-Za-z0-9._-]+@\S+").alias("text"))


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias.extract_links(table(spark, sf_dir, "pages"), "page_id", "html", LINK)


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = alias.extract_links(table(spark, sf_dir, "pages"), "page_id", "html", LINK)
    return links.where(F.length("link") % 2 == 0).select("link").distinct().select("link", F.concat(F.lit("/x?a=1&b="), F.length("link")).alias("target"))


def rewrite_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alias.rewrite_links(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html", LINK, _known(spark, sf_dir))


def label_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = alias.extract_links(table(spark, sf_dir, "pages"), "page_id", "html", LINK)
    return alias.label_links(links, "page_id", _known(spark, sf_dir)).select("page_id", "pos", "link", "label")


def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("length(token) > 3")
    terms = table(spark, sf_dir, "region").select(F.lower("r_name").alias("term")).unionByName(table(spark, sf_dir, "nation").select(F.lower("n_name").alias("term")))
    return alias.fuzzy_tag(words, terms.unionByName(table(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]{6,}", 0)).alias("term")).where("term <> ''")), 0.75)


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("_", F.lower("p_brand"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", forms.short_name(name).alias("short"), forms.clip_name(name, 12).alias("clipped"), forms.board_no(F.col("p_name")).alias("board"))


def row_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.records import reassemble_rows

    plays = F.when(F.col("o_orderkey") % 3 == 0, "S4 S2|DA").when(F.col("o_orderkey") % 3 == 1, "").otherwise("HK")
    head = F.concat_ws(",", *(F.concat(F.lit(f"f{i}-"), F.col("o_custkey")) for i in range(11)))
    line = F.concat_ws(",", head, F.concat_ws(",", F.array_repeat("o_orderpriority", (F.col("o_orderkey") % 4).cast("int"))), plays, (F.col("o_orderkey") % 20).cast("string"), F.lit("lin=a"), F.col("o_orderstatus"))
    rows = reassemble_rows(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), "line")
    return rows.select("o_orderkey", *(F.col("fields")[i].alias(n) for i, n in ((0, "board"), (11, "explanations"), (12, "cardplay"), (13, "claim"), (14, "lin_url"))))


QUERIES = {f.__name__: f for f in (fnv_hash, pseudonyms, alias_collisions, alias_summary, anonymize_columns, anonymize_records, aligned_replace, replace_rules, mask_fixed, redact_terms, extract_links, rewrite_hrefs, label_links, fuzzy_terms, name_forms, row_reassembly)}

_HASH = "list_reduce(list_prepend({basis}::hugeint, list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '\\1,', 'g')[:-2], ','), lambda b: ('0x' || b)::hugeint)), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616)"


def _hash(text: str) -> str:
    return _HASH.format(basis=(hashing.BASIS_HI << 32) + hashing.BASIS_LO, text=text)


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _pseudonym(text: str, firsts: tuple[str, ...], lasts: tuple[str, ...]) -> str:
    return f"(select {_list(firsts)}[(h % {len(firsts)})::int + 1] || '_' || {_list(lasts)}[((h // {len(firsts)}) % {len(lasts)})::int + 1] from (select {_hash(text)} as h))"


def _alternation(terms: list[str]) -> str:
    return "|".join(t.replace(".", r"\.") for t in sorted(terms, key=lambda t: (-len(t), t)))


def _cases(rules: dict[str, str], value: str) -> str:
    return "case " + value + " " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.items()) + " end"


def _replaced(table_: str, key: str, text: str, rules: dict[str, str]) -> str:
    p = _alternation(list(rules))
    return f"""select {key}, list_reduce(list_concat([''], list_transform(generate_series(1, len(g)), lambda i: (case when i = 1 then '' else {_cases(rules, 'm[i - 1]')} end) || g[i])), lambda a, b: a || b) as text
        from (select {key}, regexp_split_to_array({text}, '{p}') as g, regexp_extract_all({text}, '{p}') as m from {table_})"""


_ALIASES = f"""given as (select lower(c_name) as entity, 'Amber_Ash_' || c_custkey as alias from customer where c_custkey % 100 = 7),
    rest as (select lower(c_name) as entity, c_custkey as seen, {_pseudonym("'k1:' || lower(c_name)", FIRSTS, LASTS)} as base from customer where lower(c_name) not in (select entity from given)),
    num as (select *, row_number() over (partition by base order by seen, entity) as n from rest),
    free as (select base, case when i = 1 then base else base || '_' || i end as candidate, i from (select distinct base from rest), generate_series(1, (select count(*) from customer)) as s(i)),
    ok as (select *, row_number() over (partition by base order by i) as n from free where candidate not in (select alias from given)),
    aliases as (select entity, alias, false as generated from given union all select entity, candidate as alias, true as generated from num join ok using (base, n))"""
_LINKS = """l as (select page_id, unnest(generate_series(0, len(x) - 1)) as pos, unnest(x) as link from (select page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) as x from pages))"""

SQL = {
    "fnv_hash": f"select c_custkey, ({_hash('c_name')})::varchar as hash from customer",
    "pseudonyms": f"""select c_custkey, {_pseudonym("'k1:' || lower(c_name)", alias.FIRST, alias.LAST)} as alias from customer""",
    "alias_collisions": f"with {_ALIASES} select * from aliases",
    "alias_summary": f"with {_ALIASES} select count(*) as n_names, count(*) filter (not generated) as explicit, count(*) filter (generated) as generated, count(distinct alias) as n_aliases from aliases",
    "anonymize_columns": f"with {_ALIASES}, o as (select o_orderkey, 'CUSTOMER#' || lpad(o_custkey::varchar, 9, '0') as player from orders) select o_orderkey, coalesce(alias, player) as player from o left join aliases on lower(player) = entity",
    "anonymize_records": """select event_id, 'lin=pn|' || array_to_string([case (event_id + i) % 5 when 0 then 'Amber' when 1 then 'Birch' when 2 then 'Cedar' else 'u' || ((event_id + i) % 5) end for i in [0, 1, 2, 3]], ',') || '|st||md|3|' as record from events""",
    "aligned_replace": f"""with t as (select doc_id, unnest(range(len(x))) as line, unnest(x) as t from (select doc_id, string_split(text, chr(10)) as x from documents)),
        g as (select doc_id, line, regexp_split_to_array(t, '(?i)({_alternation(list(TERMS))})') as g, regexp_extract_all(t, '(?i)({_alternation(list(TERMS))})') as m from t),
        p as (select doc_id, line, list_transform(range(1, len(g) + 1), lambda i: {{'text': g[i], 'debt': 0::bigint, 'm': case when i = 1 then '' else m[i - 1] end, 'r': case when i = 1 then '' else {_cases(TERMS, 'lower(m[i - 1])')} end, 'gap': length(g[i]) - length(regexp_replace(g[i], '^\\s+', ''))}}) as p from g)
        select doc_id, line::int as line, list_reduce(p, lambda a, b: {{'text': a.text || b.r || case when b.gap > 0 then repeat(' ', greatest(b.gap + a.debt + length(b.m) - length(b.r), 1)) || b.text[b.gap + 1:] else b.text end,
            'debt': case when b.gap > 0 then 0 else a.debt + length(b.m) - length(b.r) end, 'm': '', 'r': '', 'gap': 0}}).text as t from p""",
    "fuzzy_terms": r"""with w as (select distinct token from (select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as token from documents) where length(token) > 3),
        t as (select distinct term from (select lower(r_name) as term from region union all select lower(n_name) from nation union all select lower(regexp_extract(text, '[A-Za-z]{6,}')) from benchmark) where term <> '')
        select token, term from w join t on abs(length(token) - length(term)) <= 2
        where token = term or (length(term) > 3 and list_sum(list_transform(range(1, least(length(token), length(term)) + 1), lambda i: (token[i] = term[i])::int)) / least(length(token), length(term)) >= 0.75)""",
    "replace_rules": _replaced("documents", "doc_id", "text", TEXT_RULES),
    "mask_fixed": _replaced("documents", "doc_id", "text", {k: v[: len(k)].ljust(len(k)) for k, v in TEXT_RULES.items()}),
    "redact_terms": r"select conv_id, turn, regexp_replace(regexp_replace(text, '[A-Za-z0-9._-]+@\S+', '[link]', 'g'), 'and|the', '', 'g') as text from conversations",
    "extract_links": f"with {_LINKS} select page_id, pos::int as pos, link from l",
    "label_links": f"with {_LINKS} select page_id, pos::int as pos, link, 'Hand ' || row_number() over (partition by page_id order by pos) as label from l where length(link) % 2 = 0",
    "rewrite_hrefs": f"""with {_LINKS}, g as (select page_id, regexp_split_to_array(html, 'href="/[^"]*"') as g, regexp_extract_all(html, 'href="(/[^"]*)"', 1) as m from pages)
        select page_id, list_reduce(list_concat([''], list_transform(generate_series(1, len(g)), lambda i: (case when i = 1 then '' when length(m[i - 1]) % 2 = 0 then 'href="/x?a=1&amp;b=' || length(m[i - 1]) || '"' else 'href="' || m[i - 1] || '"' end) || g[i])), lambda a, b: a || b) as html from g""",
    "name_forms": """with n as (select p_partkey, lower(p_brand) || '_' || p_name as name, p_name from part)
        select p_partkey, split_part(name, '_', 1) || '...' as short, case when length(name) > 12 then substr(name, 1, 9) || '...' else name end as clipped, try_cast(regexp_extract(p_name, '(\\S+)\\s*$', 1) as int) as board from n""".replace("\\\\", "\\"),
    "row_reassembly": """with o as (select o_orderkey, o_custkey, o_orderkey % 4 as r, case when o_orderkey % 3 = 0 then 'S4 S2|DA' when o_orderkey % 3 = 1 then '' else 'HK' end as plays, o_orderkey % 20 as c, o_orderstatus as st, array_to_string(list_resize([]::varchar[], o_orderkey % 4, o_orderpriority), ',') as ex from orders),
        k as (select *, c <= 13 and (r > 0 or plays <> '') as plain, r = 0 and plays = '' as two from o)
        select o_orderkey, 'f0-' || o_custkey as board,
            case when r = 0 then case when c <= 13 or plays = '' then '' else ',' || plays || ',' || c || ',lin=a,' || st end when c <= 13 then ex else ex || ',' || plays || ',' || c || ',lin=a,' || st end as explanations,
            case when r = 0 and plays = '' then '' when c <= 13 then plays else '' end as cardplay,
            case when r = 0 and plays = '' then '' when c <= 13 then c::varchar else '' end as claim,
            case when r = 0 and plays = '' then c || ',lin=a,' || st when c <= 13 then 'lin=a,' || st else '' end as lin_url from k""",
}
