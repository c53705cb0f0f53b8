"""Report tables: boards beside the hotspots that name them, links beside boards, texts of plays and auctions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.links import link_key, percent_decode, to_https
from ..functions.text import alternation
from . import alias, rates
from .keys import dedupe_by_key

LEAD_CATEGORIES = ("Lead", "Opening Lead")


def tag_boards(boards: DataFrame, hotspots: DataFrame, key: str) -> DataFrame:
    """boards with the ordinal and category of the first hotspot of their key, NULL without one."""
    first = dedupe_by_key(hotspots.select(key, "ordinal", "category"), [key], F.col("ordinal"))
    return boards.join(first, key, "left")


def locate_hotspots(hotspots: DataFrame, boards: DataFrame) -> DataFrame:
    """hotspots with board_row: where the board stands that has the key as its id, or as its link under https."""
    places = boards.select(F.explode(F.array(F.col("board_id").cast("string"), to_https(F.col("link")))).alias("_key"), "row_id").where("_key is not null")
    first = places.groupBy("_key").agg(F.min("row_id").alias("board_row"))
    return hotspots.withColumn("_key", to_https(F.col("key"))).join(first, "_key", "left").drop("_key")


def categories(hotspots: DataFrame) -> DataFrame:
    """Categories with their number of entries, in the order in which they appear."""
    return hotspots.groupBy("category").agg(F.min("ordinal").alias("first_at"), F.count("*").alias("n"))


def mapping_table(document_boards: DataFrame, board_map: DataFrame) -> DataFrame:
    """Document boards beside the dataset's; unknown ones have 0 and an empty link."""
    return document_boards.join(board_map, "doc_board", "left").fillna({"dataset_board": 0, "link": ""})


def lead_seat(hotspots: DataFrame, declarers: DataFrame, lead_categories: tuple[str, ...] = LEAD_CATEGORIES) -> DataFrame:
    """hotspots with the seat on lead, for categories about leads only. declarers: board_id, declarer (N, E, S, W)."""
    after = F.translate(F.upper("declarer"), "NESW", "ESWN")
    return hotspots.join(declarers.select("board_id", "declarer"), "board_id", "left").withColumn("lead_seat", F.when(F.col("category").isin(*lead_categories), after)).drop("declarer")


def link_tables(links: DataFrame, direct: DataFrame, by_deal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched links, and all links with board, target and source ('key', 'deal' or ''). links: link, deal; direct: link_key, board, target; by_deal: deal, board, target."""
    one = links.withColumn("link_key", link_key(F.col("link")))
    first = F.struct("board", "target")  # of several boards of a key or deal the smallest
    a = dedupe_by_key(direct.select("link_key", "board", "target"), ["link_key"], first).select("link_key", F.col("board").alias("_b1"), F.col("target").alias("_t1"))
    b = dedupe_by_key(by_deal.select("deal", "board", "target"), ["deal"], first).select("deal", F.col("board").alias("_b2"), F.col("target").alias("_t2"))
    both = one.join(a, "link_key", "left").join(b, "deal", "left")
    index = both.select("link", F.coalesce("_b1", "_b2", F.lit(0)).alias("board"), F.coalesce("_t1", "_t2", F.lit("")).alias("target"), F.when(F.col("_b1").isNotNull(), "key").when(F.col("_b2").isNotNull(), "deal").otherwise("").alias("source"))
    return index.where("source <> ''"), index


def report_tables(boards: DataFrame, hotspots: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables of a report: boards with their first hotspot, hotspots, categories and a one-row summary."""
    summary = hotspots.agg(F.count("*").alias("hotspots"), F.count_if(F.col("outcome") == "Hit").alias("hits"), F.count_if(F.col("outcome") == "Miss").alias("misses"))
    return {"boards": tag_boards(boards, hotspots, key), "hotspots": hotspots, "categories": categories(hotspots), "summary": summary.crossJoin(boards.agg(F.count("*").alias("boards")))}


def cardplay_table(lookup: DataFrame, boards: DataFrame) -> DataFrame:
    """board_id, cardplay, n_tricks and board_row of a lookup's rows that have plays; board_row is NULL for boards that the report hasn't."""
    rows = lookup.where(F.coalesce("cardplay", F.lit("")) != "").select("board_id", "cardplay", F.size(F.split("cardplay", r"\|")).alias("n_tricks"))
    first = boards.groupBy("board_id").agg(F.min("row_id").alias("board_row"))
    return rows.join(first, "board_id", "left")


def mapping_sheet(board_map: DataFrame, boards: DataFrame, anonymous: bool = True) -> DataFrame:
    """doc_board, link, dataset_board and board_row of a mapping table (text columns doc_board, dataset_board, link).

    Numbers come out as such, other text beside them as doc_text and dataset_text. anonymous: the table's own links, escapes
    decoded; else the boards' links, by number."""
    number = lambda c: F.trim(F.col(c)).try_cast("long")
    rows = board_map.select(number("doc_board").alias("doc_board"), F.when(number("doc_board").isNull(), F.trim("doc_board")).alias("doc_text"), number("dataset_board").alias("dataset_board"), F.when(number("dataset_board").isNull(), F.trim("dataset_board")).alias("dataset_text"), F.nullif(F.trim("link"), F.lit("")).alias("_own"))
    first = boards.groupBy(F.col("board_id").alias("dataset_board")).agg(F.min_by(F.struct("row_id", "link"), "row_id").alias("_b"))
    out = rows.join(first, "dataset_board", "left")
    link = percent_decode(F.col("_own")) if anonymous else F.col("_b.link")
    return out.select("doc_board", "doc_text", link.alias("link"), "dataset_board", "dataset_text", F.col("_b.row_id").alias("board_row"))


def player_stats_table(counters: DataFrame, k: int = 2) -> DataFrame:
    """rated() of every entity and of FIELD, all but the k with most deals, to 4 places."""
    field = rates.field_total(counters, k).withColumn("entity", F.lit("FIELD"))
    both = rates.rated(counters.withColumn("entity", F.col("entity").cast("string")).unionByName(field))
    return both.select("entity", *rates.COUNTERS, *(F.round(c, 4).alias(c) for c in ("decl_rate", "decl_ci", "def_rate", "def_ci", "diff")))


def trim_plays(category: Column, plays: Column, lead_categories: tuple[str, ...] = LEAD_CATEGORIES) -> Column:
    """What of the plays a report shows: the first card where the lead is meant, nothing else."""
    return F.when(category.isin(*lead_categories), F.slice(plays, 1, 1)).otherwise(F.array().cast("array<string>"))


def commentary(**lines: Column) -> Column:
    """label: value on a line each; lines without a value are left out."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label.replace('_', ' ')}: "), value.cast("string")) for label, value in lines.items()))


def auction_text(calls: Column) -> Column:
    """Calls (structs of call, alert, note) joined by dashes, alerts marked."""
    return F.array_join(F.transform(calls, lambda c: F.concat(c["call"], F.when(c["alert"], "!").otherwise(""))), "-")


def explanations_text(calls: Column) -> Column:
    noted = F.filter(calls, lambda c: c["note"].isNotNull())
    return F.array_join(F.transform(noted, lambda c: F.concat(c["call"], F.lit("="), F.replace(c["note"], F.lit(" "), F.lit("+")))), "|")


def declarer_of(lead: Column, hands: dict[str, Column]) -> Column:
    """The seat before the one whose hand (an array of cards) holds the first card."""
    before = {"N": "W", "E": "N", "S": "E", "W": "S"}
    return F.coalesce(*(F.when(F.array_contains(h, lead), F.lit(before[s])) for s, h in hands.items()))


def compass_hands(declarer: Column, by_role: list[Column]) -> dict[str, Column]:
    """Hands of declarer, leader, dummy and third player at their seats."""
    at = F.instr(F.lit("NESW"), declarer) - 1
    every = F.array(*by_role)
    return {s: F.when(at >= 0, F.element_at(every, (F.lit(i) - at + 4) % 4 + 1)) for i, s in enumerate("NESW")}


def coerce_cells(df: DataFrame, numbers: list[str], dates: list[str] = ()) -> DataFrame:
    """Text as numbers where it is one (else NULL beside the text kept as <name>_text), dates with dots."""
    out = df.withColumns({f"{c}_text": F.col(c) for c in numbers}).withColumns({c: F.col(c).try_cast("double") for c in numbers})
    return out.withColumns({c: F.replace(F.col(c).cast("string"), F.lit("-"), F.lit(".")) for c in dates}) if dates else out


def seeded_aliases(spark: SparkSession, seed: str, n: int) -> DataFrame:
    """n aliases that a seed gives: position and alias, repeats numbered."""
    names = spark.range(n).select(F.lower(F.concat(F.lit(f"{seed}-"), F.col("id"))).alias("entity"), F.col("id").alias("seen"))
    return alias.assign_aliases(names, seed).join(names, "entity").select(F.col("seen").alias("position"), "alias")


def derive_link_map(originals: DataFrame, replaced: DataFrame, link: str, target: str) -> DataFrame:
    """link_key, target from two tables with equal row_id; the first row of a key wins."""
    both = originals.select("row_id", link_key(F.col(link)).alias("link_key")).join(replaced.select("row_id", F.col(target).alias("target")), "row_id")
    return dedupe_by_key(both.where("link_key <> '' and target <> ''"), ["link_key"], F.col("row_id")).drop("row_id")


def subject_map(aliases: DataFrame) -> DataFrame:
    """Only names that were given: a generated alias for a common word must not reach report texts."""
    return aliases.where(~F.col("generated"))


def replace_links_in_text(lines: DataFrame, line: str, known: DataFrame, pattern: str = r"https?://tinyurl\.com/\S+") -> DataFrame:
    """The first link of a line by its board id ([unknown] without one), the target put at the end. known: link_key, board, target."""
    found = F.regexp_extract(line, pattern, 0)
    rows = lines.withColumn("_link", found).withColumn("link_key", link_key(F.col("_link")))
    rows = rows.join(known, "link_key", "left")
    at = F.instr(F.col(line), F.col("_link"))
    new = F.concat(F.substring(F.col(line), F.lit(1), at - 1), F.coalesce(F.col("board").cast("string"), F.lit("[unknown]")), F.substring(F.col(line), at + F.length("_link"), F.length(line)), F.coalesce(F.concat(F.lit(" "), F.col("target")), F.lit("")))
    return rows.withColumn(line, F.when(F.col("_link") == "", F.col(line)).otherwise(new)).drop("_link", *known.columns)


def replace_links(df: DataFrame, column: str, known: DataFrame, on_missing: str | None = None) -> DataFrame:
    """df with the links in a column replaced by the board of their key; empty cells stay, unknown links too unless on_missing says what stands for them.

    known: link_key, board; of several boards of a key the smallest."""
    one = known.groupBy(F.col("link_key").alias("_k")).agg(F.min(F.col("board").cast("string")).alias("_b"))
    old = F.col(f"`{column}`")
    rows = df.join(one, link_key(old) == F.col("_k"), "left")
    new = F.coalesce("_b", old if on_missing is None else F.lit(on_missing))
    return rows.withColumn(column, F.when(F.coalesce(old, F.lit("")) != "", new).otherwise(old)).select(*df.columns)


def anonymize_case(table: DataFrame, columns: list[str], order: Column, key: str, reports: DataFrame, line: str, explicit: dict[str, str], known: DataFrame | None = None, pattern: str = r"https?://tinyurl\.com/\S+") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table with its names replaced, report lines with the given names replaced in place and, if known says which, their links
    by boards, and the aliases.

    Names get their aliases in the order in which they first appear in the table; order must sort its rows. Links go before names, so
    that a name in a link isn't taken for one; targets of links have aliases already."""
    spark = table.sparkSession
    given = spark.createDataFrame(list(explicit.items()), "entity string, alias string") if explicit else None
    out, aliases = alias.anonymize_table(table, key, tuple(columns), order, given)
    texts = reports if known is None else replace_links_in_text(reports, line, known, pattern)
    texts = texts.withColumn(line, alias.replace_aligned(F.col(line), explicit)) if explicit else texts
    return out, texts, aliases


def has_term(text: Column, terms: list[str]) -> Column:
    return text.rlike(alternation(terms, True))


def enrich_records(records: DataFrame, lookup: DataFrame, columns: tuple[str, ...] = ("cardplay", "lin_url")) -> DataFrame:
    """records (row_id and others) with columns of their lookup row, in place of any of that name; blank without one."""
    rest = [c for c in records.columns if c not in columns]
    return records.select(*rest).join(lookup.select("row_id", *columns), "row_id", "left").fillna("", list(columns))


#: What scoring adds to a record: plays and errors of the four seats, the error on the lead, its cost, levels stated and computed.
SCORED = (*(f"{what}_{seat}" for seat in "nesw" for what in ("plays", "errors")), "lead_error", "cost", "level", "claimed")


def scored_table(records: DataFrame, scores: DataFrame, columns: tuple[str, ...] = SCORED) -> DataFrame:
    """records with the score columns as text, blank for rows without a score."""
    added = scores.select("row_id", *(F.col(c).cast("string").alias(c) for c in columns))
    return enrich_records(records, added, columns)


def write_scored(records: DataFrame, scores: DataFrame, path: str, columns: tuple[str, ...] = SCORED) -> None:
    scored_table(records, scores, columns).write.csv(path, header=True, quoteAll=True, emptyValue="")


def with_ordinal(rows: DataFrame, text: str, *order: str) -> DataFrame:
    """rows with ordinal, from 1 in the order given, and sub_index, the second number of a text like 3.2 (NULL without one)."""
    from .keys import with_row_id

    return with_row_id(rows, *order).withColumnRenamed("row_id", "ordinal").withColumn("sub_index", F.regexp_extract(text, r"^\s*\d+\.(\d+)", 1).try_cast("int"))


def case_tables(boards: DataFrame, analysis: DataFrame, hotspots: DataFrame, time: str = "event_time") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A case's three tables with ids as numbers; rows whose id is none are dropped. time may be text or a timestamp."""
    clean = lambda df: df.withColumn("id", F.col("id").cast("string").try_cast("long")).where("id is not null")
    return clean(boards).withColumn(time, F.try_to_timestamp(F.col(time).cast("string"))), clean(analysis), clean(hotspots)
