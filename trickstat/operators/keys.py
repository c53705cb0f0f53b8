"""Row identity, maps with a stated rule for conflicts, lookups and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.tables import stored


def with_sums_before(df: DataFrame, sums: dict[str, str], order: str, *group: str, block: int = 1024) -> DataFrame:
    """df with, for each column named in sums, the sum of it over the rows before (by order, within group) under the name given.

    Rows are taken in blocks of so many on average: sums within a block, and over the blocks before. So a million rows
    of one group are a thousand blocks of a thousand, linear in the rows, and no task sorts more than that."""
    at = "_in_block"
    size = df.groupBy(*group).agg(F.count("*").alias("_rows_in"), F.min(order).alias("_low"), F.max(order).alias("_high"))
    rows = df.join(size, list(group)) if group else df.crossJoin(F.broadcast(size))  # one row
    wide = (F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_rows_in") / block)
    rows = rows.withColumn(at, F.floor((F.col(order) - F.col("_low")) / wide)).drop("_rows_in", "_low", "_high")
    upto = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*group, at).agg(*(F.sum(c).alias(f"{n}_all") for c, n in sums.items()))
    blocks = blocks.select(*group, at, *(F.coalesce(F.sum(f"{n}_all").over(upto), F.lit(0)).alias(f"{n}_all") for n in sums.values()))
    within = Window.partitionBy(*group, at).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for c, n in sums.items()})
    out = rows.join(blocks, [*group, at]).withColumns({n: F.col(n) + F.col(f"{n}_all") for n in sums.values()})
    return out.select(*df.columns, *sums.values())


def with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """row_id, from 1 in the order of the columns given (they must tell rows apart). Rows are sorted by ranges; only the
    number of rows in each range comes together, so no task sees all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, "rows")
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = with_sums_before(sizes, {"_n": "_before"}, "_part").select("_part", "_before")
    out = ranged.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row per range
    return out.withColumn("row_id", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order; each task keeps n at most."""
    return df.orderBy(*order).limit(n)


def dedupe_by_key(df: DataFrame, key: list[str], order: Column, keep: str = "first") -> DataFrame:
    """A row per key: the first or last in order. Minima are aggregated before the shuffle; no window is sorted."""
    rest = [c for c in df.columns if c not in key]
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*key).agg(pick(F.struct(*rest), order).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def zip_rows(a: DataFrame, b: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Row i of a beside row i of b; the shorter side decides. Rows keep the ids they were read with."""
    return a.join(b, row_id)


def union_override(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both maps; where both have a key, the second's row."""
    both = first.withColumn("_rank", F.lit(0)).unionByName(second.withColumn("_rank", F.lit(1)))
    return dedupe_by_key(both, [key], F.col("_rank"), "last").drop("_rank")


def unmatched(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key).distinct(), key, "left_anti")


def pending(df: DataFrame, done: DataFrame, key: str, failed: Column) -> DataFrame:
    """Rows without a good result yet: those that are missing in done or failed there."""
    return df.join(done.where(~failed).select(key).distinct(), key, "left_anti")


def resolve(df: DataFrame, direct: DataFrame, key: str, second: DataFrame, second_key: str, value: str, default: str = "") -> DataFrame:
    """value by key, else by second_key, else default."""
    a = direct.select(key, F.col(value).alias("_a"))
    b = second.select(second_key, F.col(value).alias("_b"))
    return df.join(a, key, "left").join(b, second_key, "left").withColumn(value, F.coalesce("_a", "_b", F.lit(default))).drop("_a", "_b")


def diff_counts(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Both counts per key, and whether they are equal, off by one, different, missing or unexpected."""
    both = expected.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "full")
    a, b = F.col("expected"), F.col("actual")
    return both.withColumn("verdict", F.when(b.isNull(), "missing").when(a.isNull(), "unexpected").when(a == b, "equal").when(F.abs(a - b) == 1, "off by one").otherwise("different"))


def by_first_appearance(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with where each appears first."""
    return df.groupBy(value).agg(F.min(position).alias("first_at"))
