"""Error rates of entities in two roles, a field baseline, tests against it, partners and flags.

Input trials have a row per entity and event: entity, declaring (boolean), plays, errors. Statistics are sums, so
partial aggregation does most of the work before the one shuffle by entity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

COUNTERS = ["deals", "decl_deals", "def_deals", "decl_plays", "decl_errors", "def_plays", "def_errors"]


def role_stats(trials: DataFrame) -> DataFrame:
    """Counters per entity; entities that are null or empty are dropped."""
    own = lambda c, role: F.sum(F.when(role, F.col(c)).otherwise(0)).cast("long")
    yes, no = F.col("declaring"), ~F.col("declaring")
    return (
        trials.where(F.coalesce(F.col("entity").cast("string"), F.lit("")) != "")
        .groupBy("entity")
        .agg(
            F.count("*").alias("deals"),
            F.count_if(yes).alias("decl_deals"),
            F.count_if(no).alias("def_deals"),
            own("plays", yes).alias("decl_plays"),
            own("errors", yes).alias("decl_errors"),
            own("plays", no).alias("def_plays"),
            own("errors", no).alias("def_errors"),
        )
    )


def seat_role_stats(boards: DataFrame) -> DataFrame:
    """Counters per player from boards with player_X, plays_X, errors_X for X in n, e, s, w and declarer (a seat letter).

    Names are lower-cased. What both hands of the declaring side play counts for the declarer; dummy takes part
    in the number of deals only. Boards without a declarer or any plays are left out. Sides go by names: a name
    in two seats counts as its role says.
    """
    seats = "nesw"
    seat = F.lower(F.substring(F.trim("declarer"), 1, 1))
    rows = boards.withColumn("_seat", seat).where(F.col("_seat").isin(*seats) & (sum((F.coalesce(F.col(f"plays_{s}"), F.lit(0)) for s in seats), F.lit(0)) > 0))
    name = lambda s: F.lower(F.coalesce(F.col(f"player_{s}"), F.lit("")))
    pick = lambda shift: F.coalesce(*(F.when(F.col("_seat") == s, name(seats[(i + shift) % 4])) for i, s in enumerate(seats)))
    rows = rows.withColumns({"_declarer": pick(0), "_dummy": pick(2)})
    each = rows.select("_declarer", "_dummy", F.explode(F.array(*(F.struct(name(s).alias("name"), F.coalesce(F.col(f"plays_{s}"), F.lit(0)).alias("plays"), F.coalesce(F.col(f"errors_{s}"), F.lit(0)).alias("errors")) for s in seats))).alias("x")).where("x.name <> ''")
    side = F.col("x.name").isin(F.col("_declarer"), F.col("_dummy"))
    work = each.select(F.when(side, F.col("_declarer")).otherwise(F.col("x.name")).alias("entity"), side.alias("side"), "x.plays", "x.errors", F.lit(0).alias("deals"), F.lit(0).alias("decl_deals"), F.lit(0).alias("def_deals"))
    part = each.select(F.col("x.name").alias("entity"), F.lit(True).alias("side"), F.lit(0).alias("plays"), F.lit(0).alias("errors"), F.lit(1).alias("deals"), (F.col("x.name") == F.col("_declarer")).cast("int").alias("decl_deals"), (~side).cast("int").alias("def_deals"))
    own = lambda c, role: F.sum(F.when(role, F.col(c)).otherwise(0)).cast("long")
    return (
        work.unionByName(part)
        .where("entity <> ''")
        .groupBy("entity")
        .agg(
            *(F.sum(c).cast("long").alias(c) for c in COUNTERS[:3]),
            own("plays", F.col("side")).alias("decl_plays"),
            own("errors", F.col("side")).alias("decl_errors"),
            own("plays", ~F.col("side")).alias("def_plays"),
            own("errors", ~F.col("side")).alias("def_errors"),
        )
    )


def skipped_boards(boards: DataFrame) -> DataFrame:
    """reason, n: how many boards seat_role_stats() takes, and how many it leaves out for which reason (the first that applies)."""
    seats = "nesw"
    seat = F.lower(F.substring(F.trim("declarer"), 1, 1))
    plays = sum((F.coalesce(F.col(f"plays_{s}"), F.lit(0)) for s in seats), F.lit(0))
    reasons = [("no declarer", F.coalesce(F.trim("declarer"), F.lit("")) == ""), ("bad seat", ~seat.isin(*seats)), ("no plays", plays <= 0)]
    return reason_counts(eligibility(boards, reasons))


def rated(counters: DataFrame, interval: str = "wilson") -> DataFrame:
    """counters with decl_rate, def_rate, their half-widths, diff, diff_se and rel_pct."""
    width = {"wilson": stats.wilson_half_width, "wald": stats.wald_half_width}[interval]
    a, b = (F.col("decl_errors"), F.col("decl_plays")), (F.col("def_errors"), F.col("def_plays"))
    out = counters.withColumns({"decl_rate": stats.error_rate(*a), "def_rate": stats.error_rate(*b), "decl_ci": width(*a), "def_ci": width(*b), "diff_se": stats.diff_se(*a, *b)})
    return out.withColumns({"diff": F.col("def_rate") - F.col("decl_rate"), "rel_pct": stats.relative_change(F.col("decl_rate"), F.col("def_rate")), "low_conf": stats.low_confidence(F.col("decl_rate"), F.col("decl_ci")) | stats.low_confidence(F.col("def_rate"), F.col("def_ci"))})


def subjects(counters: DataFrame, k: int = 2) -> DataFrame:
    """The k entities with most deals; the name decides ties."""
    return counters.orderBy(F.desc("deals"), "entity").limit(k)


def field_total(counters: DataFrame, k: int = 2) -> DataFrame:
    """One row: the counters of all but the subjects, summed. Subjects are k rows, so they are broadcast."""
    rest = counters.join(F.broadcast(subjects(counters, k).select("entity")), "entity", "left_anti")
    return rest.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS))


def z_vs_field(counters: DataFrame, k: int = 2) -> DataFrame:
    """rated() with z and p of an entity's role difference against the field's, and a verdict."""
    field = rated(field_total(counters, k)).select(F.col("diff").alias("_diff"), F.col("diff_se").alias("_se"))
    out = rated(counters).crossJoin(F.broadcast(field))  # one row
    z = (F.col("diff") - F.col("_diff")) / F.sqrt(F.col("diff_se") ** 2 + F.col("_se") ** 2)
    return out.withColumn("z", z).withColumn("p", stats.normal_cdf(F.col("z"))).withColumn("verdict", stats.verdict(F.col("z"), F.col("p"))).drop("_diff", "_se")


def ranked(counters: DataFrame, *order: str, descending: tuple[str, ...] = ()) -> DataFrame:
    """counters with place, from 1: by the columns given (those in descending from the highest), then entity. Sorted by ranges, so no
    task sees all. Nulls stand last."""
    from .keys import with_row_id

    names, out = [], counters
    for i, c in enumerate(order):
        out = out.withColumns({f"_null{i}": F.col(c).isNull(), f"_by{i}": -F.col(c) if c in descending else F.col(c)})
        names += [f"_null{i}", f"_by{i}"]
    return with_row_id(out, *names, "entity").withColumnRenamed("row_id", "place").drop(*names)


def most_deals(counters: DataFrame) -> DataFrame:
    """All entities with their place by deals."""
    return ranked(counters, "deals", descending=("deals",))


def flagged_by_p(tested: DataFrame, least_deals: int = 50, below: float = -0.05, p: float = 0.20) -> DataFrame:
    """flagged() with place, the smallest p first."""
    return ranked(flagged(tested, least_deals, below, p), "p")


def flagged(tested: DataFrame, least_deals: int = 50, below: float = -0.05, p: float = 0.20) -> DataFrame:
    """Entities that do better in the second role than the field would have it."""
    return tested.where((F.col("deals") >= least_deals) & (F.col("diff") < below) & (F.col("p") < p))


#: Pairs or counts that a task of pair_counts() holds at once, and rows or pairs for which it takes one partition.
HELD = 1 << 19
EACH = 250_000
#: Blocks that it deals the members of large groups to at most, unless a block or a pair of blocks would have more than MEMBERS on average.
BLOCKS = 32
MEMBERS = 1 << 20
#: Entities that label_partners() broadcasts at most.
NODES = 500_000


def pair_counts(members: DataFrame, group: str, entity: str, block: int = 2000) -> DataFrame:
    """a, b, n: in how many groups two entities (a < b) occur together.

    Pairs of groups of block members at most are made in the task that has the group, counted in parts of HELD, and then added up. Members
    of larger groups are dealt to blocks by the entity alone, so a pair is in one pair of blocks whatever the group: each pair of blocks (the
    triangle) is a key of its own, whose task counts the pairs over all groups. These pairs, which may be far more than the input, aren't
    shuffled; what is sent is each member once for each block. Blocks have block members of the largest group or, as there are BLOCKS at
    most, more, so what is sent grows with the members, not with their square. Where there are groups of both kinds, the counts of the small ones go to the
    pairs of blocks too. Numbers of partitions follow from the sizes of the groups (one row per size on the driver). Rows that mostly repeat are
    made distinct before they are sent, unless the session's partitions would then have more than EACH."""
    parts = lambda x: max(-(-int(x) // EACH), 1)
    one = members.select(F.col(group).alias("_g"), F.col(entity).alias("e")).where(F.col("e").isNotNull() & F.col("_g").isNotNull())
    count = one.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.xxhash64("_g", "e")).alias("distinct")).first()
    given = parts(min(count["rows"], 1.25 * count["distinct"]))
    repeated = 2 * count["distinct"] < count["rows"] and count["distinct"] <= EACH * int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = one.distinct() if repeated else one.repartition(given, "_g", "e").distinct()
    sizes = one.select("_g").repartition(given, "_g").groupBy("_g").agg(F.count("*").alias("_n"))
    many = {r["_n"]: r["k"] for r in sizes.groupBy("_n").agg(F.count("*").alias("k")).collect()}
    dealt, beside = sum(k * n for n, k in many.items() if n > block), sum(k * n * (n - 1) for n, k in many.items() if n <= max(block, BLOCKS))
    blocks = min(max(-(-max(many, default=0) // block), 1), max(BLOCKS, -(-dealt // MEMBERS), math.isqrt(2 * beside // MEMBERS)))
    most = max(block, blocks)
    small, large = {n: k for n, k in many.items() if n <= most}, {n: k for n, k in many.items() if n > most}
    made = sum(k * n * (n - 1) // 2 for n, k in small.items())
    kind = members.schema[entity].dataType.simpleString()
    few = one.join(sizes.where(F.col("_n") <= most), "_g", "left_semi") if large else one
    lists = few.repartition(parts(sum(k * n for n, k in small.items())), "_g").groupBy("_g").agg(F.sort_array(F.collect_list("e")).alias("m")).where(F.size("m") > 1)
    pairs = lists.select("m").mapInArrow(_pairs_of_lists, f"a {kind}, b {kind}, n long")
    if not large:
        return pairs.repartition(parts(made), "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    sent, counted = blocks * sum(k * n for n, k in large.items()) + 2 * made, sum(k * n * (n - 1) // 2 for n, k in large.items())
    rows = one.join(sizes.where(F.col("_n") > most), "_g", "left_semi").withColumn("_own", own("e")).repartition(parts(sent / 16), "_g", "_own").groupBy("_g", "_own").agg(F.sort_array(F.collect_list("e")).alias("m"))
    other = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o"))
    cells = other.select(F.least("_own", "_o").alias("_i"), F.greatest("_own", "_o").alias("_j"), "_g", "_own", "m", F.lit(0).cast("long").alias("n"))
    if made:
        i, j = own("a"), own("b")
        turned = F.when(i <= j, F.array("a", "b")).otherwise(F.array("b", "a"))
        cells = cells.unionByName(pairs.select(F.least(i, j).alias("_i"), F.greatest(i, j).alias("_j"), F.lit(None).cast(cells.schema["_g"].dataType).alias("_g"), F.lit(-1).alias("_own"), turned.alias("m"), "n"))
    cell = (F.col("_j") * (F.col("_j") + 1) / 2).cast("int") + F.col("_i")
    cells = cells.repartitionById(min(max(parts(sent / 16), parts(counted / 64)), blocks * (blocks + 1) // 2), cell).sortWithinPartitions("_i", "_j", "_g", "_own")
    out = cells.select("_i", "_j", "_own", "_g", "m", "n").mapInArrow(_pairs_of_cells, f"x {kind}, y {kind}, n long")
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")


def _pairs_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each sorted list with their number; equal ones are counted together while HELD."""
    held, size = [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        if held:
            yield from pa.concat_tables(held).group_by(["a", "b"]).aggregate([([], "count_all")]).select(["a", "b", "count_all"]).rename_columns(["a", "b", "n"]).to_batches()

    for batch in batches:
        lists = batch.column("m")
        values, ends = lists.values, lists.offsets.to_numpy()
        lengths = np.diff(ends)
        for k in np.unique(lengths).tolist():
            low, high = np.triu_indices(k, 1)
            starts, step = ends[:-1][lengths == k], max(HELD // len(low), 1)
            for at in range(0, len(starts), step):
                base = starts[at : at + step, None]
                x, y = (base + low).ravel(), (base + high).ravel()
                for cut in range(0, len(x), HELD):
                    held.append(pa.table({"a": values.take(pa.array(x[cut : cut + HELD])), "b": values.take(pa.array(y[cut : cut + HELD]))}))
                    size += len(held[-1])
                    if size >= HELD:
                        yield from counted()
                        held, size = [], 0
    yield from counted()


def _pairs_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """x, y, n of each pair of blocks. Rows come in order of the pair of blocks, then of the group: a group's members in either block, and
    (own -1) pairs that are counted already."""
    held, size = [], 0
    for (i, j), rows in groupby(_cell_rows(batches), key=lambda r: r[:2]):
        for x, y, n in _counted_cell(i == j, i, [r[2:] for r in rows]):
            held.append(pa.RecordBatch.from_arrays([x, y, pa.array(n)], ["x", "y", "n"]))
            size += len(n)
            if size >= HELD:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """i, j, own, group, members, n; pairs that are counted already come together where they follow each other."""
    for batch in batches:
        i, j, own, n = (batch.column(c).to_numpy() for c in ("_i", "_j", "_own", "n"))
        values, ends = batch.column("m").values, batch.column("m").offsets.to_numpy()
        new = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (own[1:] != -1) | (own[:-1] != -1))
        at = np.append(np.flatnonzero(new), len(i))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield int(i[a]), int(j[a]), int(own[a]), batch.column("_g")[a].as_py(), values.slice(ends[a], ends[b] - ends[a]), n[a:b]


def _counted_cell(same: bool, i: int, rows: list[tuple]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Pairs of one pair of blocks, over all groups, in tables of HELD counts at most (or of one entity's)."""
    lefts, rights, groups = [], [], []
    before = group = None
    for own, g, members, n in rows:
        if g != group and (g == g or group == group):  # NaN is a group
            before, group = None, g
        if own == -1:
            lefts.append(members.take(pa.array(np.arange(0, len(members), 2))))
            rights.append(members.take(pa.array(np.arange(1, len(members), 2))))
            groups.append(n)
        elif same or before is not None:
            lefts.append(members if same else before)
            rights.append(members)
            groups.append(None)
            before = None
        elif own == i:
            before = members
    if not groups:
        return
    if same:
        both = pa.concat_arrays([*lefts, *rights]).dictionary_encode()
        names, codes = (both.dictionary,) * 2, both.indices.to_numpy()
        p, q = codes[: sum(map(len, lefts))], codes[sum(map(len, lefts)) :]
    else:
        x, y = pa.concat_arrays(lefts).dictionary_encode(), pa.concat_arrays(rights).dictionary_encode()
        names, p, q = (x.dictionary, y.dictionary), x.indices.to_numpy(), y.indices.to_numpy()
    p, q = np.split(p, np.cumsum([*map(len, lefts)])[:-1]), np.split(q, np.cumsum([*map(len, rights)])[:-1])
    wide = len(names[1])
    step = max(HELD // wide, 1)
    full = [None if same or n is not None or 4 * len(b) < wide else np.bincount(b, minlength=wide) for b, n in zip(q, groups, strict=True)]
    for low in range(0, len(names[0]), step):
        counts = np.zeros((min(step, len(names[0]) - low), wide), np.int64)
        for a, b, n, row in zip(p, q, groups, full, strict=True):
            if n is not None:
                a, b = (np.minimum(a, b), np.maximum(a, b)) if same else (a, b)
                here = (a >= low) & (a < low + len(counts))
                np.add.at(counts, (a[here] - low, b[here]), n[here])
            else:
                here = a[(a >= low) & (a < low + len(counts))]
                if row is not None:
                    counts[here - low] += row
                else:
                    counts[np.ix_(here - low, b)] += here[:, None] < b if same else 1
        at = np.flatnonzero(counts)
        k, m = np.divmod(at, wide)
        yield names[0].take(pa.array(k + low)), names[1].take(pa.array(m)), counts.ravel()[at]


def convergence(counters: DataFrame) -> DataFrame:
    """The two subjects' gap in each role, and whether it narrows or widens in the second."""
    top = rated(subjects(counters)).select("entity", "deals", "decl_rate", "def_rate")
    place = F.row_number().over(Window.orderBy(F.desc("deals"), "entity"))  # two rows
    both = top.withColumn("place", place)
    side = lambda i: both.where(F.col("place") == i).select(*(F.col(c).alias(f"{c}_{i}") for c in ("entity", "decl_rate", "def_rate")))
    out = side(1).crossJoin(side(2))
    out = out.select(F.col("entity_1").alias("entity_a"), F.col("entity_2").alias("entity_b"), (F.col("decl_rate_1") - F.col("decl_rate_2")).alias("decl_gap"), (F.col("def_rate_1") - F.col("def_rate_2")).alias("def_gap"))
    change = F.abs("decl_gap") - F.abs("def_gap")
    return out.withColumn("convergence", change).withColumn("reading", F.when(change > 1, "narrows").when(change < -1, "widens").otherwise("similar"))


def label_partners(flagged_: DataFrame, pairs: DataFrame, share: float = 0.6) -> DataFrame:
    """flagged_ (entity, deals, p) with partner_no, null for those without a partner.

    In order of (p, entity) each free entity takes the free partner it met most often (then the smaller name), if they
    met in at least share of the smaller number of deals. Rounds do this for many at once: an undecided entity
    that no better one lies within two edges of decides now. The number is the rank of the entity that took. Entities are stored and,
    up to NODES, broadcast, so pairs aren't shuffled; beyond, pairs are stored too and joined in partitions of EACH on average. So are the
    open edges of each round.
    """
    from ..streaming.tables import stored
    from .keys import with_row_id

    dealt = lambda d, n, by: d.repartition(max(-(-n // EACH), 1), by)
    nodes = stored(flagged_.select("entity", "deals", "p"), "nodes")
    if nodes.count() <= NODES:
        side = F.broadcast
    else:
        pairs = stored(pairs, "pairs")
        count = pairs.count()
        side = lambda d: dealt(d, count, d.columns[0])
        pairs = dealt(pairs, count, "a")
    own = lambda x: side(nodes.select(F.col("entity").alias(x), F.col("deals").alias(f"d{x}"), F.col("p").alias(f"p{x}")))
    edge = pairs.join(own("a"), "a").join(own("b"), "b").where(F.col("n") >= share * F.least("da", "db"))
    both = edge.select("a", "b", "n", "pa", "pb").unionByName(edge.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", F.col("pb").alias("pa"), F.col("pa").alias("pb")))
    open_ = stored(both.select("a", "b", "n", F.struct(F.col("pa").alias("p"), F.col("a").alias("e")).alias("ra"), F.struct(F.col("pb").alias("p"), F.col("b").alias("e")).alias("rb")), "edges")
    claims = None
    while left := open_.count():  # the best open entity of all always decides, so each round closes some edges
        mine = dealt(open_, left, "a")
        near = mine.groupBy("a").agg(F.min(F.least("ra", "rb")).alias("m"))
        wide = dealt(open_, left, "b").join(near.select(F.col("a").alias("b"), "m"), "b").select("a", "ra", "m")
        first = dealt(wide, left, "a").groupBy("a", "ra").agg(F.min("m").alias("m")).where("ra = m").select("a")
        taken = mine.join(first, "a", "left_semi").groupBy("a", "ra").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("b").alias("b"))).alias("best")).select("a", F.col("ra.p").alias("p"), F.col("best.b").alias("b"))
        taken = stored(taken, "claims")
        claims = taken if claims is None else claims.unionByName(taken)
        gone = dealt(taken.select(F.col("a").alias("x")).unionByName(taken.select(F.col("b").alias("x"))), left, "x")
        rest = mine.join(gone, mine["a"] == gone["x"], "left_anti")
        open_ = stored(dealt(rest, left, "b").join(gone, rest["b"] == gone["x"], "left_anti"), "edges")
    if claims is None:
        return nodes.withColumn("partner_no", F.lit(None).cast("int"))
    number = with_row_id(claims, "p", "a").withColumn("partner_no", F.col("row_id").cast("int"))
    labels = number.select(F.col("a").alias("entity"), "partner_no").unionByName(number.select(F.col("b").alias("entity"), "partner_no"))
    return nodes.join(labels, "entity", "left")


def partnered_share(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count_if(F.col("partner_no").isNotNull()).alias("partnered"), F.count_if(F.col("partner_no").isNull()).alias("alone"))


def errors_by(events: DataFrame, *keys: str, cost: str = "cost") -> DataFrame:
    """Number and summed cost of errors (rows with a cost) per key."""
    return events.where(F.col(cost) > 0).groupBy(*keys).agg(F.count("*").alias("n_errors"), F.sum(cost).alias("cost"))


def error_matrix(errors: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Number of errors per row and column, as columns err_<value>; values are stated, so one pass is enough."""
    return errors.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"err_{v}") for v in values), F.count("*").alias("total"))


def error_average(errors: DataFrame, row: str, board: str, dummy: Column, n: Column) -> DataFrame:
    """row, total errors, boards on which it wasn't dummy, and their quotient to 2 places (NULL if it always was)."""
    each = errors.groupBy(row, board).agg(F.sum(n).alias("_n"), F.min(dummy.cast("int")).alias("_dummy"))
    out = each.groupBy(row).agg(F.sum("_n").cast("long").alias("total"), F.count_if(F.col("_dummy") == 0).alias("boards"))
    return out.withColumn("average", F.round(F.col("total") / F.nullif(F.col("boards"), F.lit(0)), 2))


def level_match(computed: Column, given: Column) -> Column:
    """Whether both agree, NULL where nothing was given (null or negative)."""
    return F.when(given >= 0, computed == given)


def validate_levels(df: DataFrame, row: Column, computed: Column, given: Column, most: int = 20) -> DataFrame:
    """One row: matches, mismatches, not_given, the first mismatches (row, computed, given; most at most, by row) and overflow, how many more there are.
    Nothing is given where given is null or negative, or nothing computed; a null row counts as -1.

    One pass: each task counts, and keeps its first mismatches beside the counters; what meets is most rows of each task."""
    rows = df.select(F.coalesce(row.cast("long"), F.lit(-1)).alias("row"), computed.cast("double").alias("computed"), given.cast("double").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first = [0, 0, 0], []
        for batch in batches:
            ok = pc.and_(pc.fill_null(pc.greater_equal(batch["given"], 0), False), batch["computed"].is_valid())
            same = pc.equal(batch["computed"], batch["given"])
            wrong = batch.filter(pc.fill_null(pc.and_(ok, pc.invert(same)), False))
            counts[0] += pc.sum(pc.and_(ok, pc.fill_null(same, False))).as_py() or 0
            counts[1] += wrong.num_rows
            counts[2] += batch.num_rows - (pc.sum(ok).as_py() or 0)
            if wrong.num_rows:
                best = wrong.take(pc.select_k_unstable(wrong, most, [("row", "ascending"), ("computed", "ascending"), ("given", "ascending")]))
                first = sorted(first + best.to_pylist(), key=lambda r: (r["row"], r["computed"], r["given"]))[:most]
        kind = pa.list_(pa.struct([("row", pa.int64()), ("computed", pa.float64()), ("given", pa.float64())]))
        yield pa.RecordBatch.from_arrays([*(pa.array([c], pa.int64()) for c in counts), pa.array([first], kind)], ["matches", "mismatches", "not_given", "first"])

    parts = rows.mapInArrow(run, "matches long, mismatches long, not_given long, first array<struct<row: long, computed: double, given: double>>")
    total = parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matches", "mismatches", "not_given")), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, most).alias("first"))
    return total.withColumn("overflow", F.greatest(F.col("mismatches") - most, F.lit(0)))


def eligibility(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """df with reason: the first that applies, null for eligible rows."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(reasons):
        reason = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))
