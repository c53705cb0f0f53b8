"""Mixing sources to target weights: raking of token weights, then sampling; DataFrame functions only.

Iterative proportional fitting over cells (source, language, topic): each step scales the cells' token weights so
that one of the three margins fits its targets. Rounds of three steps go on until no cell moves any more; LIMIT rounds
without that are an error. A cell's rate is its weight by its tokens: how often each of its documents is expected in the
mix. A document is taken rate times: the whole part, and once more with the fraction as probability. So no probability
is cut off, and the shares of the sample's tokens are those of the weights but for the draws' chance. Draws are a hash of doc_id
and seed, so a document's fate doesn't depend on partitions or repeats.

Topics are a column if the caller has one, else the form of the text: table, marked, short, medium or long.
Targets are shares per value of each margin; those not given are the margin's own token shares, tempered:
tokens ** TEMPER, normalised. Where no weights meet all targets, the last margin's are met and the others' may not be:
margins() says for each value what it has been given and what it reaches.

Nulls: a null source, lang or topic is the value ''; a null or empty text has no tokens and its cell weighs
nothing by itself, such documents have the rate of their cell, 1 if the cell has no tokens. Repeated rows
share one draw. A very long text is one row like any other. Further columns of any name do no harm. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

MARGINS = ("source", "lang", "topic")
TEMPER = 0.8
SEED = 17
#: Raking ends when no cell moves by more than this share of all tokens in STEP rounds.
SETTLED = 1e-10
STEP = 4
#: A margin's value has its target if its share is as near as this.
CLOSE = 1e-6
LIMIT = 1000
#: Up to this many cells are broadcast (about 100 bytes each); more are joined by a shuffle of their keys.
BROADCAST_CELLS = 200_000
#: Cells that one task rakes; more are dealt out by the margin at hand.
CELLS_PER_TASK = 500_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def form(text: Column, tokens: Column) -> Column:
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    marks = F.length(text) - F.length(F.translate(text, "#*$%&<>", ""))
    return F.when(20 * bars > tokens, "table").when(10 * marks > tokens, "marked").when(tokens < 100, "short").when(tokens < 1000, "medium").otherwise("long")


def celled(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, source, lang, topic and row, the caller's columns, for each of docs."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    value = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), token_count(text).alias("n_tokens"), value(docs["source"]).alias("source"), value(docs["lang"]).alias("lang"), text.alias("text"), (F.lit("") if topic is None else value(topic)).alias("topic"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    return rows.withColumn("topic", form(F.col("text"), F.col("n_tokens")) if topic is None else F.col("topic")).drop("text")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight, whose margins meet the targets (value, share) where they can, and rate."""
    parts = -(-cells.count() // CELLS_PER_TASK) or 1
    now = cells.coalesce(1) if parts == 1 else cells.repartition(parts)
    total = cells.agg(F.sum("tokens").alias("total"))
    now = now.crossJoin(F.broadcast(total))  # one row
    for margin in MARGINS:
        if targets and margin in targets:
            share = targets[margin].select(F.col("value").alias(margin), F.col("share").cast("double").alias(f"share_{margin}"))
            now = now.join(share, margin, "left").fillna(0.0, [f"share_{margin}"])
        else:
            by = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("part"))
            norm = by.agg(F.sum("part").alias("norm"))
            share = by.crossJoin(F.broadcast(norm)).select(margin, F.when(F.col("norm") > 0, F.col("part") / F.col("norm")).otherwise(0.0).alias(f"share_{margin}"))
            now = now.join(share, margin)
    now = now.withColumn("weight", F.col("tokens").cast("double"))
    now = stored(now.coalesce(1) if parts == 1 else now, "cells")
    for _ in range(0, LIMIT, STEP):
        now = now.withColumn("before", F.col("weight"))
        now = now.coalesce(1) if parts == 1 else now  # a single partition needs no exchange for any margin
        for margin in MARGINS * STEP:
            held = F.sum("weight").over(Window.partitionBy(margin))
            now = now.withColumn("held", held).withColumn("weight", F.when(F.col("held") > 0, F.col("weight") * (F.col(f"share_{margin}") * F.col("total") / F.col("held"))).otherwise(0.0))
        now = stored(now.drop("held"), "cells")
        if (now.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.col("total"))).first()[0] or 0) <= SETTLED:
            break
    else:
        raise RuntimeError(f"weights aren't settled after {LIMIT} rounds")
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0)
    return now.select(*MARGINS, "tokens", "weight", F.round(rate, 6).alias("rate"))


def margins(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER) -> DataFrame:
    """margin, value, tokens, target, reached (shares of all tokens) and met, for each value of each margin, also for values
    that have a target and no cells, or cells and no target (then 0)."""
    fitted = stored(raked(cells, targets, temper), "raked")
    whole = fitted.agg(F.sum("tokens").alias("total"))
    found = []
    for margin in MARGINS:
        by = fitted.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight"))
        if targets and margin in targets:
            share = targets[margin].select("value", F.col("share").cast("double").alias("target"))
        else:
            part = F.pow(F.col("tokens").cast("double"), F.lit(temper))
            norm = by.agg(F.sum(part).alias("norm"))
            share = by.crossJoin(F.broadcast(norm)).select("value", F.when(F.col("norm") > 0, part / F.col("norm")).alias("target"))  # one row
        reached = F.when(F.col("total") > 0, F.col("weight") / F.col("total"))
        rows = by.join(share, "value", "full").crossJoin(F.broadcast(whole))  # one row
        found.append(rows.select(F.lit(margin).alias("margin"), "value", "tokens", "target", reached.alias("reached")).fillna(0, ["tokens", "target", "reached"]))
    out = found[0].unionByName(found[1]).unionByName(found[2])
    return out.withColumn("met", F.abs(F.col("target") - F.col("reached")) <= CLOSE)


def calibrated(rows: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER) -> DataFrame:
    """celled() rows with tokens, weight and rate of their cell."""
    cells = stored(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    fitted = raked(cells, targets, temper)
    if fitted.count() <= BROADCAST_CELLS:
        fitted = F.broadcast(fitted)
    return rows.join(fitted, list(MARGINS))


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """How often a document is taken: rate is what to expect."""
    return (F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight (of the cell), rate and copies, for every document."""
    rows = stored(celled(docs).drop("row"), "celled")
    out = calibrated(rows, targets, temper)
    return out.select("doc_id", *MARGINS, "n_tokens", F.round("weight", 3).alias("weight"), "rate", copies(F.col("rate"), F.col("doc_id"), seed).alias("copies"))


def sampled(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, seed: int = SEED) -> DataFrame:
    """Documents, all columns as they are, each as often as copies() says: the tokens' shares are near the targets."""
    out = calibrated(celled(docs), targets, temper).where(copies(F.col("rate"), F.col("doc_id"), seed) > 0)
    return out.select(F.explode(F.array_repeat("row", copies(F.col("rate"), F.col("doc_id"), seed).cast("int"))).alias("row")).select("row.*")


def mixed_sql(rounds: int = 40, temper: float = TEMPER, seed: int = SEED) -> str:
    """mixed() over the table documents, as SQL whose recursion takes one raking step at a time, more than any fit needs."""
    bars, marks = "length(t) - length(replace(t, '|', ''))", "length(t) - length(translate(t, '#*$%&<>', ''))"
    steps = ["""docs as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_tokens from documents)""",
        f"rows as (select doc_id, source, lang, n_tokens, case when 20 * ({bars}) > n_tokens then 'table' when 10 * ({marks}) > n_tokens then 'marked' when n_tokens < 100 then 'short' when n_tokens < 1000 then 'medium' else 'long' end as topic from docs)",
        "cells as (select source, lang, topic, sum(n_tokens)::double as tokens from rows group by all)"]
    for m in MARGINS:
        steps.append(f"part_{m} as (select {m}, pow(sum(tokens), {temper}) as part from cells group by all)")
        steps.append(f"share_{m} as (select {m}, part / (select sum(part) from part_{m}) as s_{m} from part_{m})")
    shares = " ".join(f"join share_{m} using ({m})" for m in MARGINS)
    steps.append(f"""w as (select 0 as step, source, lang, topic, tokens, tokens as weight, s_source, s_lang, s_topic, (select sum(tokens) from cells) as total from cells {shares}
        union all select step + 1, source, lang, topic, tokens, case when held > 0 then weight * (case step % 3 when 0 then s_source when 1 then s_lang else s_topic end * total / held) else 0 end, s_source, s_lang, s_topic, total
        from (select *, sum(weight) over (partition by case step % 3 when 0 then source when 1 then lang else topic end) as held from w) where step < {3 * rounds})""")
    steps.append(f"p as (select *, round(case when tokens > 0 then weight / tokens else 1.0 end, 6) as rate from w where step = {3 * rounds})")
    return "with recursive " + ",\n".join(steps) + f"""
        select doc_id, source, lang, topic, n_tokens::bigint as n_tokens, round(weight, 3) as weight, rate,
        (floor(rate) + case when ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double / 4294967296.0 < rate - floor(rate) then 1 else 0 end)::bigint as copies
        from rows join p using (source, lang, topic)"""
