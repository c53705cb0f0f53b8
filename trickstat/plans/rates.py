"""Queries over error rates: suppliers and users stand for players, line items and events for plays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import rates
from .tables import table

RATED = ["entity", *rates.COUNTERS, "decl_rate", "def_rate", "decl_ci", "def_ci", "diff", "rel_pct", "low_conf"]
ROUNDED = ("decl_rate", "def_rate", "decl_ci", "def_ci", "diff", "diff_se", "rel_pct", "z", "p", "decl_gap", "def_gap", "convergence")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in df.columns))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rates.role_stats(rows.select(F.col("l_suppkey").alias("entity"), (F.col("l_linestatus") == "O").alias("declaring"), F.lit(1).alias("plays"), (F.col("l_returnflag") == "R").cast("int").alias("errors")))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rates.role_stats(rows.select(F.col("user_id").alias("entity"), (F.col("event_id") % 2 == 0).alias("declaring"), F.lit(1).alias("plays"), (F.col("event_type") == "error").cast("int").alias("errors")))


def role_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rates.rated(_suppliers(spark, sf_dir)).select(*RATED))


def role_rates_wald(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rates.rated(_suppliers(spark, sf_dir), "wald").select(*RATED))


def event_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rates.rated(_users(spark, sf_dir)).select(*RATED))


def field_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.field_total(_users(spark, sf_dir))


def z_vs_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rates.z_vs_field(_users(spark, sf_dir)).select("entity", "deals", "diff", "diff_se", "z", "p", "verdict"))


def flagged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rates.flagged(rates.z_vs_field(_users(spark, sf_dir)), p=0.5).select("entity", "deals", "diff", "z", "p"))


def top_pair_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rates.convergence(_users(spark, sf_dir)))


def _order_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.pair_counts(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_pairs(spark, sf_dir)


def partner_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tested = rates.flagged(rates.z_vs_field(_suppliers(spark, sf_dir)), p=0.6)
    labelled = rates.label_partners(tested, _order_pairs(spark, sf_dir), share=0.02)
    return labelled.select("entity", "deals", F.round("p", 6).alias("p"), "partner_no")


def partnered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.partnered_share(partner_labels(spark, sf_dir))


REASONS = [("done", "o_orderstatus = 'F'"), ("incomplete", "o_totalprice < 20000"), ("passed", "o_orderpriority like '5%'")]


def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.reason_counts(rates.eligibility(table(spark, sf_dir, "orders"), [(n, F.expr(t)) for n, t in REASONS]))


def error_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rates.error_matrix(rows.where("value > 50"), "user_id", "event_type", ["view", "signup", "error", "click", "purchase"])


def errors_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("cost", F.floor(F.greatest(F.col("value") - 50, F.lit(0.0))).cast("long"))
    return rates.errors_by(rows, "user_id")


def level_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(rates.level_match(F.floor("value"), F.when(F.col("event_type") != "signup", F.floor(F.col("value") + 0.25)).otherwise(-1)).alias("ok"), "event_type")
    return rows.groupBy("event_type").agg(F.count_if("ok").alias("matches"), F.count_if(~F.col("ok")).alias("mismatches"), F.count_if(F.col("ok").isNull()).alias("not_given"))


def level_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 mismatching rows: a report's list."""
    rows = table(spark, sf_dir, "events").where(~rates.level_match(F.floor("value"), F.floor(F.col("value") + 0.25)))
    return rows.orderBy("event_id").limit(20).select("event_id", F.floor("value").alias("computed"), F.floor(F.col("value") + 0.25).alias("given"))


QUERIES = {f.__name__: f for f in (role_rates, role_rates_wald, event_error_rates, field_baseline, z_vs_field, flagged_entities, top_pair_convergence, pair_counts, partner_labels, partnered_share, eligibility_reasons, error_matrix, errors_by_user, level_validation, level_mismatches)}

_SUPPLIERS = "select l_suppkey as entity, l_linestatus = 'O' as d, 1 as plays, (l_returnflag = 'R')::int as errors from lineitem"
_USERS = "select user_id as entity, event_id % 2 = 0 as d, 1 as plays, (event_type = 'error')::int as errors from events"


def _counters(source: str) -> str:
    return f"""t as ({source}), c as (select entity, count(*) as deals, count(*) filter (d) as decl_deals, count(*) filter (not d) as def_deals,
        coalesce(sum(plays) filter (d), 0)::bigint as decl_plays, coalesce(sum(errors) filter (d), 0)::bigint as decl_errors,
        coalesce(sum(plays) filter (not d), 0)::bigint as def_plays, coalesce(sum(errors) filter (not d), 0)::bigint as def_errors from t where entity is not null group by entity)"""


def _width(e: str, n: str, kind: str) -> str:
    p, z = f"({e}::double / {n})", "1.96"
    if kind == "wald":
        return f"case when {n} >= 30 then 1.96 * sqrt({p} * (1 - {p}) / {n}) * 100 end"
    scale = f"(1 + {z} * {z} / {n})"
    centre, margin = f"(({p} + {z} * {z} / (2.0 * {n})) / {scale})", f"({z} / {scale} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})))"
    return f"case when {n} >= 30 then greatest(abs({p} - ({centre} - {margin})), abs({centre} + {margin} - {p})) * 100 end"


def _rated(source: str = "c", kind: str = "wilson") -> str:
    rate = lambda e, n: f"case when {n} > 0 then {e}::double / {n} * 100 else 0.0 end"
    a, b = ("decl_errors", "decl_plays"), ("def_errors", "def_plays")
    p, q = "(decl_errors::double / decl_plays)", "(def_errors::double / def_plays)"
    se = f"case when decl_plays >= 30 and def_plays >= 30 then sqrt({p} * (1 - {p}) / decl_plays + {q} * (1 - {q}) / def_plays) * 100 end"
    return f"""(select *, def_rate - decl_rate as diff, case when decl_rate <> 0 then (def_rate - decl_rate) / decl_rate * 100 else 0.0 end as rel_pct,
        coalesce(decl_ci > greatest(decl_rate, 5.0), false) or coalesce(def_ci > greatest(def_rate, 5.0), false) as low_conf
        from (select *, {rate(*a)} as decl_rate, {rate(*b)} as def_rate, {_width(*a, kind)} as decl_ci, {_width(*b, kind)} as def_ci, {se} as diff_se from {source}))"""


_OUT = ", ".join(f"round({c}, 6) as {c}" if c in ROUNDED else c for c in RATED)
_FIELD = f"""s as (select entity from c order by deals desc, entity limit 2),
    f as (select {', '.join(f'coalesce(sum({c}), 0)::bigint as {c}' for c in rates.COUNTERS)} from c where entity not in (select entity from s))"""
_T = f"(1 / (1 + {stats.ERF_P} * abs(z / sqrt(2.0))))"
_POLY = f"(((((({stats.ERF_A[4]} * {_T} + {stats.ERF_A[3]}) * {_T}) + {stats.ERF_A[2]}) * {_T} + {stats.ERF_A[1]}) * {_T} + {stats.ERF_A[0]}) * {_T})"
_TESTED = f"""g as {_rated('f')}, r as {_rated('c')},
    z0 as (select r.*, (r.diff - g.diff) / sqrt(r.diff_se * r.diff_se + g.diff_se * g.diff_se) as z from r cross join g),
    z1 as (select *, 0.5 * (1 + sign(z) * (1 - {_POLY} * exp(-(z / sqrt(2.0)) * (z / sqrt(2.0))))) as p from z0)"""
_VERDICT = """case when z is null then 'no data' else (case when p < 0.001 then 'p<0.001' when p < 0.01 then 'p<0.01' when p < 0.05 then 'p<0.05' else 'not significant' end)
    || ' ' || (case when z < -1.96 then 'low' when z > 1.96 then 'normal' else 'inconclusive' end) end"""
_PAIRS = "m as (select distinct l_orderkey as g, l_suppkey as e from lineitem), pairs as (select x.e as a, y.e as b, count(*) as n from m x join m y on x.g = y.g and x.e < y.e group by all)"
#: In order of (p, entity) each free one takes its best free partner; taken lists both, pair after pair.
_LABELS = f"""{_counters(_SUPPLIERS)}, {_FIELD}, {_TESTED}, {_PAIRS}, w as (select entity, deals, p, row_number() over (order by p, entity) as i from z1 where deals >= 50 and diff < -0.05 and p < 0.6),
    e as (select a, b, n from pairs union all select b, a, n from pairs), x as (select u.entity, u.i, u.deals, u.p, coalesce(list(e.b order by n desc, e.b) filter (v.entity is not null and n >= 0.02 * least(u.deals, v.deals)), []) as near
        from w u left join e on e.a = u.entity left join w v on v.entity = e.b group by all),
    greedy(i, taken) as (select 0::bigint, []::bigint[] union all
        select y.i, case when list_contains(taken, y.entity) or len(free) = 0 then taken else list_concat(taken, [y.entity, free[1]]) end from (select x.i, x.entity, taken, list_filter(near, lambda b: not list_contains(taken, b)) as free from greedy join x on x.i = greedy.i + 1) y),
    z as (select taken from greedy order by i desc limit 1), placed as (select unnest(taken) as entity, unnest(range(len(taken))) // 2 + 1 as partner_no from z),
    labelled as (select w.entity, deals, round(p, 6) as p, partner_no::int as partner_no from w left join placed using (entity))"""
_LEVEL = "floor(value) = case when event_type <> 'signup' then floor(value + 0.25) end"

SQL = {
    "role_rates": f"with {_counters(_SUPPLIERS)} select {_OUT} from {_rated()}",
    "role_rates_wald": f"with {_counters(_SUPPLIERS)} select {_OUT} from {_rated(kind='wald')}",
    "event_error_rates": f"with {_counters(_USERS)} select {_OUT} from {_rated()}",
    "field_baseline": f"with {_counters(_USERS)}, {_FIELD} select * from f",
    "z_vs_field": f"with {_counters(_USERS)}, {_FIELD}, {_TESTED} select entity, deals, round(diff, 6) as diff, round(diff_se, 6) as diff_se, round(z, 6) as z, round(p, 6) as p, {_VERDICT} as verdict from z1",
    "flagged_entities": f"with {_counters(_USERS)}, {_FIELD}, {_TESTED} select entity, deals, round(diff, 6) as diff, round(z, 6) as z, round(p, 6) as p from z1 where deals >= 50 and diff < -0.05 and p < 0.5",
    "top_pair_convergence": f"""with {_counters(_USERS)}, r as {_rated()}, o as (select *, row_number() over (order by deals desc, entity) as i from r),
        x as (select a.entity as entity_a, b.entity as entity_b, a.decl_rate - b.decl_rate as decl_gap, a.def_rate - b.def_rate as def_gap from o a cross join o b where a.i = 1 and b.i = 2)
        select entity_a, entity_b, round(decl_gap, 6) as decl_gap, round(def_gap, 6) as def_gap, round(abs(decl_gap) - abs(def_gap), 6) as convergence,
        case when abs(decl_gap) - abs(def_gap) > 1 then 'narrows' when abs(decl_gap) - abs(def_gap) < -1 then 'widens' else 'similar' end as reading from x""",
    "pair_counts": f"with {_PAIRS} select * from pairs",
    "partner_labels": f"with recursive {_LABELS} select * from labelled",
    "partnered_share": f"with recursive {_LABELS} select count(partner_no) as partnered, count(*) filter (partner_no is null) as alone from labelled",
    "eligibility_reasons": f"select case {' '.join(f'when {t} then {n!r}' for n, t in REASONS)} else 'eligible' end as reason, count(*) as n from orders group by 1",
    "error_matrix": "select user_id, " + ", ".join(f"count(*) filter (event_type = '{v}') as err_{v}" for v in ("view", "signup", "error", "click", "purchase")) + ", count(*) as total from events where value > 50 group by user_id",
    "errors_by_user": "select user_id, count(*) as n_errors, sum(floor(greatest(value - 50, 0)))::bigint as cost from events where floor(greatest(value - 50, 0)) > 0 group by user_id",
    "level_validation": f"select event_type, count(*) filter ({_LEVEL}) as matches, count(*) filter (not ({_LEVEL})) as mismatches, count(*) filter (({_LEVEL}) is null) as not_given from events group by event_type",
    "level_mismatches": "select event_id, floor(value)::bigint as computed, floor(value + 0.25)::bigint as given from events where floor(value) <> floor(value + 0.25) order by event_id limit 20",
}
