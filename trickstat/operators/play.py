"""Ordered plays: who leads and wins, what each step costs, and text forms of it.

Plays have board, ply (from 0), suit and rank; four plays make a trick. A board has at most 52 plays, so windows by board stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_tricks(plays: DataFrame) -> DataFrame:
    return plays.withColumns({"trick": F.floor(F.col("ply") / 4), "pos": F.col("ply") % 4})


def trick_winners(plays: DataFrame, trump: Column, first: Column) -> DataFrame:
    """board, trick, size, leader, winner (seats 0 to 3): the best trump wins, else the best of the suit led; equal ranks, the earlier.

    Which place wins depends on the trick's own cards, so the leader is the first leader moved on by the sum of the
    winning places before. A trick without four cards moves nothing.
    """
    led = F.min_by("suit", "pos").over(Window.partitionBy("board", "trick"))
    strength = F.when(F.col("suit") == F.col("_trump"), 2).when(F.col("suit") == F.col("_led"), 1).otherwise(0)
    rows = with_tricks(plays).withColumns({"_trump": trump, "_first": first}).withColumn("_led", led)
    best = rows.groupBy("board", "trick").agg(F.count("*").alias("size"), F.max_by("pos", F.struct(strength, "rank", -F.col("pos"))).alias("_won"), F.first("_first").alias("_first"))
    best = best.withColumn("_won", F.when(F.col("size") == 4, F.col("_won")).otherwise(0))
    before = Window.partitionBy("board").orderBy("trick").rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("leader", (F.col("_first") + F.coalesce(F.sum("_won").over(before), F.lit(0))) % 4)
    return best.withColumn("winner", (F.col("leader") + F.col("_won")) % 4).select("board", "trick", "size", "leader", "winner")


def with_seats(plays: DataFrame, winners: DataFrame) -> DataFrame:
    """plays with trick, pos, leader and seat."""
    return with_tricks(plays).join(winners.select("board", "trick", "leader"), ["board", "trick"]).withColumn("seat", (F.col("leader") + F.col("pos")) % 4)


def seat_counts(seated: DataFrame, error: Column) -> DataFrame:
    """board, plays_0..3, errors_0..3, and lead_error: whether the first card of all was one."""
    at = lambda s: F.col("seat") == s
    return seated.groupBy("board").agg(*(F.count_if(at(s)).alias(f"plays_{s}") for s in range(4)), *(F.count_if(at(s) & error).alias(f"errors_{s}") for s in range(4)), F.max(F.when(F.col("ply") == 0, error)).alias("lead_error"))


def tricks_won(winners: DataFrame, declarer: Column) -> DataFrame:
    """winners with won: tricks of the declaring side up to and with each trick."""
    side = ((F.col("winner") - declarer) % 2 == 0) & (F.col("size") == 4)
    return winners.withColumn("won", F.sum(side.cast("int")).over(Window.partitionBy("board").orderBy("trick")).cast("long"))


def step_costs(trace: DataFrame, declaring: Column) -> DataFrame:
    """trace (board, ply, level) with cost: what the level fell by for the declaring side, rose by for the others."""
    before = F.lag("level").over(Window.partitionBy("board").orderBy("ply"))
    change = F.coalesce(before - F.col("level"), F.lit(0))
    return trace.withColumn("cost", F.greatest(F.when(declaring, change).otherwise(-change), F.lit(0)).cast("long"))


def trick_costs(trace: DataFrame, winners: DataFrame, declarer: Column) -> DataFrame:
    """board, trick, cost, seat: changes of the level over whole tricks. A fall is the declarer's; a rise the leader's, or the next
    seat's if the leader is of the declaring side. Incomplete tricks are left out."""
    before = F.lag("level").over(Window.partitionBy("board").orderBy("ply"))
    rows = with_tricks(trace.withColumn("_before", before))
    ends = rows.groupBy("board", "trick").agg(F.min_by(F.struct("_before"), "ply")["_before"].alias("start"), F.max_by("level", "ply").alias("end"))
    both = ends.join(winners.where("size = 4"), ["board", "trick"]).withColumn("_dec", declarer)
    change = F.col("end") - F.col("start")
    defender = F.when((F.col("leader") - F.col("_dec")) % 2 != 0, F.col("leader")).otherwise((F.col("leader") + 1) % 4)
    return both.where(change != 0).select("board", "trick", F.abs(change).cast("long").alias("cost"), F.when(change < 0, F.col("_dec")).otherwise(defender).alias("seat"))


def encode_costs(costs: DataFrame) -> DataFrame:
    """board, encoded: T1:a,b,c,d|T2:... from board, ply, cost."""
    rows = with_tricks(costs).groupBy("board", "trick").agg(F.array_sort(F.collect_list(F.struct("pos", "cost"))).alias("x"))
    text = F.concat(F.lit("T"), F.col("trick") + 1, F.lit(":"), F.array_join(F.transform("x", lambda c: c["cost"].cast("string")), ","))
    rows = rows.groupBy("board").agg(F.array_sort(F.collect_list(F.struct("trick", text.alias("t")))).alias("x"))
    return rows.select("board", F.array_join(F.transform("x", lambda c: c["t"]), "|").alias("encoded"))


def decode_costs(encoded: DataFrame, column: str = "encoded") -> DataFrame:
    """Rows of board, trick (from 0), pos, cost; what is no number is dropped."""
    rest = [c for c in encoded.columns if c != column]
    tricks = encoded.select(*rest, F.explode(F.split(column, r"\|")).alias("t"))
    parts = tricks.select(*rest, F.expr("try_cast(regexp_extract(t, '^T([0-9]+):', 1) as int)").alias("n"), F.posexplode(F.split(F.regexp_replace("t", "^[^:]*:", ""), ",")).alias("pos", "c"))
    return parts.select(*rest, (F.col("n") - 1).alias("trick"), "pos", F.expr("try_cast(c as int)").alias("cost")).where("cost is not null and trick is not null")


def lines_of(values: Column, width: int = 4, sep: str = " ") -> Column:
    """An array as lines of so many values."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(width))
    return F.array_join(F.transform(starts, lambda i: F.array_join(F.slice(values, i, F.lit(width)), sep)), "\n")


def missing_of(deck: Column, *held: Column) -> Column:
    """What of the deck nobody holds, in the deck's order."""
    return F.array_except(deck, F.concat(*held))


def seat_add(seat: Column, k: int) -> Column:
    """The seat (N, E, S, W) k places clockwise."""
    at = F.instr(F.lit("NESW"), seat)
    return F.when(at > 0, F.substring(F.lit("NESW"), (at - 1 + k) % 4 + 1, F.lit(1)))


def auction_roles(opener: Column, names: dict[str, Column]) -> dict[str, Column]:
    """Who overcalls, responds and advances: the seats 1, 2 and 3 after the one whose name is the opener's (in any case)."""
    seats = F.array(*(F.lower(n) for n in names.values()))
    at = F.array_position(seats, F.lower(opener)).cast("int")
    every = F.array(*names.values())
    return {role: F.when(at > 0, F.element_at(every, (at - 1 + k) % 4 + 1)) for role, k in (("overcaller", 1), ("responder", 2), ("advancer", 3))}


def timeline_layout(df: DataFrame, year: Column, order: list[str], cols: int = 150, gap: int = 2) -> DataFrame:
    """df with year, x and y: items of a year row by row, years one above the other with a gap. order tells the items of a year apart.

    Items are numbered over all years by ranges and each year's first number taken off, so a year isn't one task's; what is
    summed or broadcast is a row per year."""
    from .keys import with_row_id

    rows = with_row_id(df.withColumn("year", year), "year", *order)
    sizes = rows.groupBy("year").agg(F.min("row_id").alias("_first"), (F.ceil(F.count("*") / cols) + gap).alias("_rows"))
    base = sizes.select("year", "_first", F.coalesce(F.sum("_rows").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # few rows
    rows = rows.join(F.broadcast(base), "year").withColumn("_i", F.col("row_id") - F.col("_first"))
    return rows.withColumns({"x": F.col("_i") % cols, "y": F.col("_base") + F.floor(F.col("_i") / cols)}).drop("_i", "_base", "_first", "row_id")


def pair_nearest(items: DataFrame, group: str, order: str, kind: str, item: str, anchor: str) -> DataFrame:
    """group, item_at, anchor_at: each item takes the last anchor since the item before; without one, the first anchor before the
    next item, unless that item takes the same one."""
    rows = items.where(F.col(kind).isin(item, anchor))
    seg = F.sum((F.col(kind) == item).cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_seg", F.coalesce(seg, F.lit(0)))
    part = rows.groupBy(group, "_seg").agg(F.min(F.when(F.col(kind) == anchor, F.col(order))).alias("_first"), F.max(F.when(F.col(kind) == anchor, F.col(order))).alias("_last"), F.max(F.when(F.col(kind) == item, F.col(order))).alias("item_at"))
    after = Window.partitionBy(group).orderBy("_seg")
    part = part.withColumns({"_next_first": F.lead("_first").over(after), "_next_last": F.lead("_last").over(after), "_next_item": F.lead("item_at").over(after)})
    later = F.when(F.col("_next_item").isNull() | (F.col("_next_first") != F.col("_next_last")), F.col("_next_first"))
    return part.where("item_at is not null").select(group, "item_at", F.coalesce("_last", later).alias("anchor_at"))


def subject_columns(boards: DataFrame, names: list[str]) -> DataFrame:
    """board, and for each named subject the plays and errors of its seat; on the declaring side (seats 0 and 2) those of both hands.
    boards: board, player_0..3, plays_0..3, errors_0..3. An absent subject gives NULL."""
    out = [F.col("board")]
    for i, name in enumerate(names):
        for what in ("plays", "errors"):
            value = F.lit(None).cast("long")
            for s in range(3, -1, -1):
                got = F.col(f"{what}_{s}") + F.col(f"{what}_{(s + 2) % 4}") if s % 2 == 0 else F.col(f"{what}_{s}")
                value = F.when(F.col(f"player_{s}") == name, got).otherwise(value)
            out.append(value.alias(f"subject{i + 1}_{what}"))
    return boards.select(*out)


def redact_spans(rows: DataFrame, group: str, order: str, text: str, start: Column, end: Column, replacement: str) -> DataFrame:
    """Texts strictly between a start row and the next end row emptied, the first non-empty one of each span replaced."""
    marker = F.when(start, "start").when(end, "end")
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_mark", marker).withColumns({"_last": F.last("_mark", True).over(w), "_span": F.count(F.when(F.col("_mark") == "start", 1)).over(w)})
    inside = (F.coalesce(F.col("_last"), F.lit("")) == "start") & F.col("_mark").isNull()
    rows = rows.withColumn("_in", inside)
    head = F.min(F.when(F.col("_in") & (F.col(text) != ""), F.col(order))).over(Window.partitionBy(group, "_span"))
    rows = rows.withColumn("_head", head)
    return rows.withColumn(text, F.when(~F.col("_in"), F.col(text)).when(F.col(order) == F.col("_head"), F.lit(replacement)).otherwise("")).drop("_mark", "_last", "_span", "_in", "_head")


def timeline_class(disclosed: Column, outcome: Column) -> Column:
    """What an item of a timeline is shown as."""
    return F.when(disclosed, "disclosed").when(outcome == "Miss", "miss").otherwise("background")


CARD = "^[SHDC]([2-9TJQKA]|10|1)$"


def explode_plays(df: DataFrame, column: str = "cardplay", strict: bool = True) -> DataFrame:
    """A row per card of texts like S4 S2|DA: all other columns, trick, pos, ply (from 0), suit and rank (2 to 14).

    Empty tricks are dropped and not counted. What is no card is an error, or NULL in suit and rank if not strict.
    """
    rest = [c for c in df.columns if c != column]
    tricks = F.filter(F.transform(F.split(F.upper(column), r"\|"), lambda t: F.trim(t)), lambda t: t != "")
    cards = F.flatten(F.transform(tricks, lambda t, i: F.transform(F.split(t, r"\s+"), lambda c, j: F.struct(i.alias("trick"), j.alias("pos"), c.alias("_c")))))
    cards = df.select(*rest, F.posexplode(cards).alias("ply", "_x")).select(*rest, "ply", "_x.*")  # numbered in its row, so equal rows don't mix
    good = F.col("_c").rlike(CARD)
    suit = F.when(good, F.substring("_c", 1, 1))
    if strict:
        suit = F.coalesce(suit, F.raise_error(F.concat(F.lit("no card: "), F.col("_c"))).cast("string"))
    face = F.regexp_replace(F.substring("_c", 2, 2), "^10?$", "T")
    cards = cards.withColumns({"suit": suit, "rank": F.when(good, F.instr(F.lit("23456789TJQKA"), face) + 1)})
    return cards.select(*rest, "trick", "pos", "suit", "rank", "ply")


def encode_plays(plays: DataFrame, key: str) -> DataFrame:
    """key, cardplay: the text that explode_plays() takes apart, from key, trick, pos, suit and rank."""
    card = F.concat("suit", F.substring(F.lit("23456789TJQKA"), F.col("rank") - 1, F.lit(1)))
    rows = plays.groupBy(key, "trick").agg(F.array_sort(F.collect_list(F.struct("pos", card.alias("c")))).alias("x"))
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("trick", F.array_join(F.transform("x", lambda c: c["c"]), " ").alias("t")))).alias("x"))
    return rows.select(key, F.array_join(F.transform("x", lambda c: c["t"]), "|").alias("cardplay"))


def trick_listing(plays: DataFrame) -> DataFrame:
    """board, trick (from 1), cards like 2:S4 in order of play, costs and their sum; plays: board, ply, seat, card, cost."""
    rows = plays.withColumn("trick", F.floor(F.col("ply") / 4) + 1).groupBy("board", "trick").agg(F.array_sort(F.collect_list(F.struct("ply", "seat", "card", "cost"))).alias("x"))
    text = lambda f, sep: F.array_join(F.transform("x", f), sep)
    return rows.select("board", "trick", text(lambda c: F.concat_ws(":", c["seat"].cast("string"), c["card"]), " ").alias("cards"), text(lambda c: c["cost"].cast("string"), ",").alias("costs"), F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c["cost"]).alias("cost"))
