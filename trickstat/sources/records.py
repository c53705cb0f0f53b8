"""Reading tolerant tables, game records and report texts; writing their text forms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.links import link_key
from ..functions.text import cards_of, dealer, short_name, vulnerability
from ..operators.keys import with_row_id
from ..streaming.tables import stored
from .lines import RANGE_BYTES, counted_ranges, numbered_lines
from .parts import write_parts

PLAYS = r"^([SHDC][2-9TJQKA]( [SHDC][2-9TJQKA])*(\|[SHDC][2-9TJQKA]( [SHDC][2-9TJQKA])*)*)?$"
SUITS = "SHDC"
DECK = [s + r for s in SUITS for r in "AKQJT98765432"]


def resolve_columns(df: DataFrame, required: list[str] = (), any_of: dict[str, list[str]] | None = None, optional: list[str] = ()) -> DataFrame:
    """The columns asked for: required by name, any_of by the first synonym that is there, optional as NULL if absent."""
    missing = [c for c in required if c not in df.columns]
    out = [F.col(f"`{c}`") for c in required if c in df.columns]
    for name, synonyms in (any_of or {}).items():
        found = next((s for s in synonyms if s in df.columns), None)
        if found is None:
            missing.append(f"{name} (tried {', '.join(synonyms)})")
        else:
            out.append(F.col(f"`{found}`").alias(name))
    if missing:
        raise ValueError(f"columns not found: {'; '.join(missing)}; there are {', '.join(df.columns)}")
    return df.select(*out, *(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional))


def repaired(line: Column) -> Column:
    """A line whose last quoted field has quotes in it, with these as apostrophes."""
    part = r'^(.*,")(.*)"$'
    return F.when(line.rlike(r'^.*,".*".*"$') & ~F.regexp_extract(line, part, 2).rlike(r'^[^"]*$'), F.concat(F.regexp_extract(line, part, 1), F.translate(F.regexp_extract(line, part, 2), '"', "'"), F.lit('"'))).otherwise(line)


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, one_table: bool = False) -> DataFrame:
    """A tolerant CSV as strings: lines before the first with a comma dropped, bare quotes in the last field mended, short rows
    filled, empty cells NULL, and row_id by position (over files by name). Empty lines are no rows. Each file has a header of its
    own, or, if they are one_table (parts of one written in order), the first with a comma only.

    row_id comes from the numbers of lines: those of a file's rows begin after all rows of the files before, which takes a row per file."""
    ranges = counted_ranges(spark, path, range_bytes)
    lines = numbered_lines(spark, path, range_bytes, ranges)
    head = F.when(F.col("head_n").isNotNull(), F.struct("start", (F.col("_lines") + F.col("head_n")).alias("line_no"), (F.col("_filled") + F.col("head_filled")).alias("filled_no"), "head"))
    files = ranges.groupBy("file").agg(F.min(head).alias("h"), F.max(F.col("_filled") + F.col("filled")).alias("all"))
    if one_table:
        first = files.where("h is not null").agg(F.min("file").alias("_first"))
        files = files.crossJoin(F.broadcast(first)).where("file >= _first").withColumn("h", F.when(F.col("file") == F.col("_first"), F.col("h")))
    else:
        files = files.where("h is not null")
    skip = F.coalesce("h.filled_no", F.lit(0))
    files = stored(files.select("file", F.coalesce("h.line_no", F.lit(0)).alias("_start"), skip.alias("_skip"), F.col("h.head").alias("header"), (F.col("all") - skip).alias("_rows")), "files")
    header = files.orderBy("file").select("header").first()
    if header is None:
        raise ValueError(f"no line of {path} has a comma")
    names = next(iter(spark.createDataFrame([(header[0],)], "line string").select(F.from_csv("line", ", ".join(f"c{i} string" for i in range(header[0].count(",") + 1))).alias("x")).first()[0:1]))
    names = [n for n in names if n is not None]
    schema = ", ".join(f"`{n}` string" for n in names)
    first = files.withColumn("_base", F.coalesce(F.sum("_rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("header", "_rows")
    body = lines.join(first, "file").where("line_no > _start and line <> ''").withColumn("_row", F.from_csv(repaired(F.col("line")), schema, {"mode": "PERMISSIVE"}))
    return body.select((F.col("_base") + F.col("filled_no") - F.col("_skip")).alias("row_id"), *(F.nullif(F.col(f"_row.`{n}`"), F.lit("")).alias(n) for n in names))


def reassemble_rows(df: DataFrame, line: str, n: int = 15, head: int = 11) -> DataFrame:
    """df with fields: the parts of an unquoted line as n fields. Of too many parts, the first after the head that looks like plays
    and has a claim (0 to 13 or nothing) after it parts the explanations from the link; without one all is explanations."""
    return df.withColumn("fields", F.element_at(F.transform(F.array(F.split(F.col(line), ",", -1)), lambda parts: _fields(parts, n, head)), 1))


def _fields(parts: Column, n: int, head: int) -> Column:
    """parts is bound once, by a lambda: it isn't split anew at each use."""
    at = F.filter(F.sequence(F.lit(head), F.greatest(F.size(parts) - 2, F.lit(head))), lambda i: F.coalesce(F.get(parts, i).rlike(PLAYS) & (F.get(parts, i + 1) == F.lit("")) | F.get(parts, i).rlike(PLAYS) & F.get(parts, i + 1).try_cast("int").between(0, 13), F.lit(False)))
    split_at = F.try_element_at(at, F.lit(1))
    text = lambda a, b: F.array_join(F.slice(parts, a + 1, F.greatest(b - a, F.lit(0))), ",")
    size = F.size(parts)
    many = F.concat(F.slice(parts, 1, head), F.array(text(F.lit(head), split_at), F.get(parts, split_at), F.get(parts, split_at + 1), text(split_at + 2, size)))
    rest = F.concat(F.slice(parts, 1, head), F.array(text(F.lit(head), size), F.lit(""), F.lit(""), F.lit("")))
    few = F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(n) - size, F.lit(0))))
    return F.when(size <= n, few).when(split_at.isNull(), rest).otherwise(many)


def record_fields(record: Column) -> Column:
    """array<struct<pos, tag, val>> of tag|value|tag|value...; percent escapes decoded first."""
    plain = F.coalesce(F.try_url_decode(F.replace(record, F.lit("+"), F.lit("%2B"))), record)
    split = F.split(F.regexp_replace(plain, "^.*?lin=", ""), r"\|")
    pairs = lambda parts: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(parts) / 2) - 1, F.lit(0))), lambda i: F.struct(i.alias("pos"), F.trim(F.get(parts, (2 * i).cast("int"))).alias("tag"), F.get(parts, (2 * i + 1).cast("int")).alias("val")))
    return F.element_at(F.transform(F.array(split), pairs), 1)  # bound by a lambda: split and decoded once


def _calls(fields: Column) -> Column:
    """array<struct<call, alert, note>>: a note is the explanation right after its call."""
    said = F.filter(fields, lambda x: x["tag"].isin("mb", "an"))

    def each(said: Column) -> Column:
        pairs = F.transform(said, lambda x, i: F.struct(x["tag"].alias("tag"), x["val"].alias("val"), F.get(said, i + 1).alias("next")))
        return F.transform(F.filter(pairs, lambda x: x["tag"] == "mb"), lambda x: F.struct(F.regexp_replace(x["val"], "!", "").alias("call"), x["val"].contains("!").alias("alert"), F.when(x["next"]["tag"] == "an", x["next"]["val"]).alias("note")))

    return F.element_at(F.transform(F.array(said), each), 1)


def parse_records(df: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """boards, calls and plays of game records. Names and hands are in the order S, W, N, E; the fourth hand is what is left of the
    deck. A record is a row, so its calls and cards are numbered in it before they become rows: nothing is shuffled."""
    fields = record_fields(F.col(column))
    deck = F.array(*map(F.lit, DECK))

    def board(f: Column) -> Column:
        first = lambda tag: F.try_element_at(F.filter(f, lambda x: x["tag"] == tag), F.lit(1))["val"]
        names, deal = F.split(first("pn"), ","), first("md")
        hands = F.split(F.substring(deal, F.lit(2), F.length(deal)), ",")
        hand = lambda i: F.coalesce(cards_of(F.get(hands, i)), F.array().cast("array<string>"))
        return F.struct(
            first("ah").alias("header"),
            dealer(F.substring(deal, 1, 1)).alias("dealer"),
            vulnerability(first("sv")).alias("vul"),
            *(F.get(names, i).alias(f"player_{s}") for i, s in enumerate("swne")),
            *(hand(i).alias(f"hand_{s}") for i, s in enumerate("swn")),
            first("mc").try_cast("int").alias("claim"),
        )

    one = df.select(F.col(key).alias("board_id"), F.explode(F.transform(F.array(fields), board)).alias("b")).select("board_id", "b.*")
    boards = one.withColumn("hand_e", F.array_except(deck, F.concat("hand_s", "hand_w", "hand_n")))
    boards = boards.select(*(c for c in boards.columns if c not in ("hand_e", "claim")), "hand_e", "claim")
    calls = df.select(F.col(key).alias("board_id"), F.posexplode(_calls(fields)).alias("pos", "x")).select("board_id", "pos", "x.*")
    cards = df.select(F.col(key).alias("board_id"), F.posexplode(F.transform(F.filter(fields, lambda x: x["tag"] == "pc"), lambda x: F.upper(x["val"]))).alias("ply", "card"))
    return boards, calls, cards.select("board_id", "ply", F.floor(F.col("ply") / 4).alias("trick"), (F.col("ply") % 4).alias("pos"), "card")


#: Columns of a lookup: its number and link, and what a record says.
LOOKUP = ("Board_ID", "TinyURL", "Board_Header", "Player_S", "Player_W", "Player_N", "Player_E", "Dealer", "Vulnerability", "Deal_PBN", "Auction", "Explanations", "Cardplay", "Claim", "LIN_URL")


def lookup_table(df: DataFrame, number: str, link: str, record: str) -> DataFrame:
    """The LOOKUP columns as text for each row of df; all but number and link are blank where record is null or has no deal, as where a link failed."""
    fields = record_fields(F.col(record))
    once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  # a lambda's argument is made once
    ranks = F.array(*map(F.lit, "AKQJT98765432"))
    of_suit = lambda hand, s: F.array_join(F.regexp_extract_all(hand, F.lit(f"{s}([^SHDC]*)"), 1), "")
    shown = lambda held, has: once(held, lambda h: F.array_join(F.filter(ranks, lambda r: F.contains(h, r) if has else ~F.contains(h, r)), ""))
    suits = lambda hand: F.concat_ws(".", *(shown(of_suit(hand, s), True) for s in SUITS))
    rest = lambda hands: F.concat_ws(".", *(shown(F.concat(*(of_suit(h, s) for h in hands)), False) for s in SUITS))

    def row(f: Column) -> Column:
        first = lambda tag: F.try_element_at(F.filter(f, lambda x: x["tag"] == tag), F.lit(1))["val"]
        names, deal, calls = F.split(first("pn"), ","), first("md"), _calls(f)
        split = F.split(F.upper(F.substring(deal, F.lit(2), F.length(deal))), ",")
        pbn = lambda h: F.concat(F.lit("N:"), F.concat_ws(" ", suits(h["n"]), rest([h["s"], h["w"], h["n"]]), suits(h["s"]), suits(h["w"])))
        hands = F.struct(*(F.coalesce(F.get(split, i), F.lit("")).alias(s) for i, s in enumerate("swn")))
        cards = F.transform(F.filter(f, lambda x: x["tag"] == "pc"), lambda x: F.upper(x["val"]))
        tricks = lambda k: F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(k), F.lit(1)), F.lit(4)), lambda i: i <= F.size(k)), lambda i: F.array_join(F.slice(k, i, F.lit(4)), " ")), "|")
        noted = F.transform(F.filter(calls, lambda c: c["note"].isNotNull()), lambda c: F.concat(c["call"], F.lit("="), F.replace(c["note"], F.lit(" "), F.lit("+"))))
        says = [
            first("ah"),
            *(F.get(names, i) for i in range(4)),
            dealer(F.substring(deal, 1, 1)),
            vulnerability(first("sv")),
            once(hands, pbn),
            F.array_join(F.transform(calls, lambda c: F.concat(c["call"], F.when(c["alert"], "!").otherwise(""))), "-"),
            F.array_join(noted, "|"),
            once(cards, tricks),
            first("mc").try_cast("int").cast("string"),
            F.col(record),
        ]
        return F.struct(*(F.when(deal.isNotNull(), F.coalesce(c, F.lit(""))).otherwise("").alias(n) for c, n in zip(says, LOOKUP[2:], strict=True)))

    blank = F.struct(*(F.lit("").alias(n) for n in LOOKUP[2:]))
    rows = df.select(F.col(number).cast("string").alias(LOOKUP[0]), F.coalesce(F.col(link), F.lit("")).alias(LOOKUP[1]), F.explode(F.transform(F.array(fields), row)).alias("x"), F.col(record).isNull().alias("_none"))
    return rows.withColumn("x", F.when(F.col("_none"), blank).otherwise(F.col("x"))).select(*LOOKUP[:2], "x.*")


def csv_line(columns: list[str]) -> Column:
    """A CSV line of text columns, each quoted."""
    return F.concat_ws(",", *(F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns))


HOTSPOT = r"^\s*(\d+)\.\s+(.+?)\s+(Hit|Miss)(?:\s+(.*?))?\s+Contract:\s*(\S+)\s+Lead:\s*(\S+)\s+(\S+)\s+"
LAYOUTS = {"aliased": HOTSPOT + r"(\d+)\s+(\S+)\s+(\S+)", "plain": HOTSPOT + r"(https?://\S+)\s+(\S+)"}


def token_hotspots(lines: DataFrame, line: str = "line") -> DataFrame:
    """Entries of a report whose subclass stands between category and Hit or Miss, by tokens; lines of fewer than seven are left out."""
    t = F.split(F.trim(line), r"\s+")
    rows = lines.withColumn("_t", t).withColumn("_at", F.greatest(F.lit(0), F.least(*(F.when(F.array_position("_t", w) > 0, F.array_position("_t", w)) for w in ("Hit", "Miss")))).cast("int"))
    rows = rows.where((F.size("_t") >= 7) & (F.col("_at") > 2) & F.get("_t", F.lit(0)).rlike(r"^\d+\.$"))
    after = lambda word, k: F.when(F.array_position("_t", word) > 0, F.get("_t", (F.array_position("_t", word) + k).cast("int")))
    return rows.select(*(c for c in lines.columns if c != line), F.regexp_replace(F.get("_t", F.lit(0)), r"\.$", "").cast("int").alias("ordinal"), F.get("_t", F.lit(1)).alias("category"), F.array_join(F.slice("_t", F.lit(3), F.col("_at") - 3), " ").alias("subclass"), F.get("_t", F.col("_at") - 1).alias("outcome"), after("Contract:", 0).alias("contract"), after("Lead:", 0).alias("lead"), after("Lead:", 1).alias("date"))


def board_map(rows: DataFrame, link_of: str = "Anon_LIN_URL") -> DataFrame:
    """doc_board, dataset_board, link, fingerprint of a mapping table's text columns; rows whose boards are no numbers are dropped."""
    number = lambda c: F.trim(F.col(c).cast("string")).try_cast("long")
    out = rows.select(number("Doc_Board").alias("doc_board"), number("Dataset_Board_ID").alias("dataset_board"), F.trim(link_of).alias("link"), F.col("Fingerprint").alias("fingerprint"))
    return out.where("doc_board is not null and dataset_board is not null")


def read_board_map(spark: SparkSession, path: str) -> DataFrame:
    return board_map(spark.read.csv(path, header=True))


def extra_map(rows: DataFrame, link: str, board: str) -> DataFrame:
    """link_key, board of a two-column map; of several boards of a link the first by text. Links without a key are dropped."""
    pairs = rows.select(link_key(F.col(link)).alias("link_key"), F.trim(F.col(board).cast("string")).alias("board"))
    return pairs.where("link_key <> ''").groupBy("link_key").agg(F.min("board").alias("board"))


def hotspots(lines: DataFrame, line: str = "line", layout: str = "lines") -> DataFrame:
    """Entries of a report in either layout (the aliased one first); other lines are left out. Any date token will do (date is NULL
    if it isn't one, date_text has it), and what follows the entry is ignored. layout "tokens": token_hotspots()."""
    if layout == "tokens":
        return token_hotspots(lines, line)
    cut = "\u0001"
    text = F.translate(F.col(line), cut, " ")

    def parts(layout: str) -> Column:
        """What the groups matched, one piece if the line isn't of that layout."""
        n = re.compile(LAYOUTS[layout]).groups
        return F.split(F.regexp_replace(text, f"(?s){LAYOUTS[layout]}.*$", cut.join(f"${i + 1}" for i in range(n))), cut, -1)

    rest = [c for c in lines.columns if c != line]
    rows = lines.select(*rest, F.explode(F.transform(F.array(parts("aliased")), lambda a: F.when(F.size(a) > 1, a).otherwise(parts("plain")))).alias("_p")).where(F.size("_p") > 1)
    names = ("ordinal", "category", "outcome", "subclass", "contract", "lead", "date_text", "key", "player")
    out = rows.select(*rest, *(F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(names)), F.get("_p", F.lit(9)).alias("link"))
    return out.select(*rest, F.col("ordinal").cast("int").alias("ordinal"), *names[1:6], F.col("date_text").try_cast("date").alias("date"), "key", "player", "link", "date_text")


def subjects(lines: DataFrame) -> DataFrame:
    """name, first_at of names listed between a header (Name ... Detector) and a line of dashes; file, line_no and line are read."""
    w = Window.partitionBy("file").orderBy("line_no")
    mark = F.when(F.col("line").rlike("^\\s*Name.*Detector"), "start").when(F.col("line").rlike("^\\s*---"), "end")
    rows = lines.withColumn("_mark", mark).withColumn("_last", F.last("_mark", True).over(w)).where("_last = 'start' and _mark is null")
    name = F.regexp_extract("line", r"^\s*(\S+)", 1)
    return rows.select(name.alias("name"), "line_no").where("name not in ('', 'pair')").groupBy("name").agg(F.min("line_no").alias("first_at"))


def alias_pairs(lines: DataFrame, line: str = "line") -> DataFrame:
    """entity, alias of lines old=new; comments and blanks are left out."""
    text = F.trim(F.col(line))
    at = F.instr(text, "=")
    return lines.where((text != "") & ~text.startswith("#") & (at > 1)).select(F.trim(F.substring(text, F.lit(1), at - 1)).alias("entity"), F.trim(F.substring(text, at + 1, F.length(text))).alias("alias"))


def alias_list(df: DataFrame, text: str) -> DataFrame:
    """entity, alias, place of texts a=b, c=d, ...: split at commas and at the first =, the longest entity first (then by text).

    Pairs without an entity or alias are left out; of several aliases of an entity the smallest counts."""
    from ..operators.rates import ranked

    parts = df.select(F.explode(F.split(F.col(text), ",")).alias("line"))
    pairs = alias_pairs(parts).where("alias <> ''").groupBy("entity").agg(F.min("alias").alias("alias"))
    return ranked(pairs.withColumn("_size", F.length("entity")), "_size", descending=("_size",)).select("entity", "alias", "place")


def pbn_blocks(boards: DataFrame) -> DataFrame:
    """id, block: a board's tags and commentary as text, for export in order of id."""
    tag = lambda name, c: F.concat(F.lit(f'[{name} "'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"]'))
    block = F.concat_ws("\n", tag("Board", "board"), tag("Dealer", "dealer"), tag("Vulnerable", "vul"), tag("Deal", "deal"), tag("Contract", "contract"), F.concat(F.lit("{"), F.coalesce("commentary", F.lit("")), F.lit("}")), F.lit(""))
    return boards.select("id", block.alias("block"))


def case_blocks(boards: DataFrame, lead_categories: tuple[str, ...] = ("Lead", "Opening Lead")) -> DataFrame:
    """id, board, block: a board's tags in the standard order, its calls four a line, the first card where the lead is meant, and a
    commentary. Boards are numbered in order of id.

    boards: id, date, south, west, north, east (names), dealer, vul, deal, contract, calls (array), category, subclass, lead,
    player, declarer. NULL fields are empty; a board without calls has no auction, one without a declarer no first card."""
    from ..operators.play import lines_of, seat_add

    rows = with_row_id(boards, "id").withColumnRenamed("row_id", "board")
    tag = lambda name, c: F.concat(F.lit(f'[{name} "'), F.coalesce(c.cast("string"), F.lit("")), F.lit('"]'))
    empty = F.lit("")
    day = F.replace(F.col("date").cast("string"), F.lit("-"), F.lit("."))
    people = [tag(s.title(), short_name(F.col(s))) for s in ("west", "north", "east", "south")]
    auction = F.when(F.size("calls") > 0, F.concat(tag("Auction", F.col("dealer")), F.lit("\n"), lines_of(F.col("calls"))))
    leads = F.col("category").isin(*lead_categories) & (F.coalesce("lead", F.lit("")) != "") & F.col("declarer").isin("N", "E", "S", "W")
    first = F.when(leads, F.concat(tag("Play", seat_add(F.col("declarer"), 1)), F.lit("\n"), F.col("lead"), F.lit(" - - -")))
    spot = F.when(F.col("category") != "", F.concat(F.lit("<b>Hotspot:</b> "), F.col("category"), F.when(F.coalesce("subclass", F.lit("")) != "", F.concat(F.lit(" / "), F.col("subclass"))).otherwise("")))
    says = [F.concat(F.lit(f"<b>{name.title()}:</b> "), F.coalesce(F.col(name), F.lit(""))) for name in ("contract", "lead", "player")]
    said = F.concat_ws("\n", spot, F.concat_ws("  ", *says), F.concat(F.lit("<b>Date:</b> "), F.col("date").cast("string")))
    tags = [tag("Event", empty), tag("Site", empty), tag("Date", day), tag("Board", F.col("board")), *people, tag("Dealer", F.col("dealer")), tag("Vulnerable", F.col("vul")), tag("Deal", F.col("deal")), tag("Scoring", empty), tag("Declarer", empty), tag("Contract", F.col("contract")), tag("Result", empty)]
    return rows.select("id", "board", F.concat_ws("\n", *tags, auction, first, F.concat(F.lit("{"), said, F.lit("}")), F.lit("")).alias("block"))


def write_blocks(blocks: DataFrame, path: str, mode: str = "append") -> None:
    """Numbered text parts in order of id, with a manifest."""
    write_parts(blocks, ["id"], "block", path, mode=mode)


def write_lookup(df: DataFrame, path: str, columns: tuple[str, ...] = LOOKUP, order: str = "Board_ID", mode: str = "append") -> None:
    """CSV parts in the order of a number, all cells quoted, empty for NULL, the header once."""
    rows = df.select(F.col(order).cast("long").alias("_order"), csv_line(list(columns)).alias("line"))
    write_parts(stored(rows, "lookup"), ["_order"], "line", path, header=",".join(columns), mode=mode)
