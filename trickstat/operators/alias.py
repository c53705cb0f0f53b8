"""Pseudonyms for entities, and their replacement in columns, records, links and free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.text import alternation, fuzzy_match

#: Made by a rule: 240 first and 120 last names, so 28,800 bases over which entities spread.
FIRST = tuple(a + b + c for a in ("Al", "Be", "Co", "Da", "El", "Fa", "Gre", "Ha") for b in ("la", "mi", "no", "ri", "sa") for c in ("", "n", "r", "s", "th", "x"))
LAST = tuple(a + b for a in ("Ash", "Brook", "Cliff", "Dune", "Elm", "Field", "Glen", "Hill", "Isle", "Lake", "Moor", "Oak") for b in ("", "by", "dale", "ford", "gate", "ham", "ley", "ton", "wick", "wood"))


def pseudonym(name: Column, key: str, firsts: tuple[str, ...] = FIRST, lasts: tuple[str, ...] = LAST) -> Column:
    """First_Last of the keyed hash of a name; list words hold no underscore."""
    h = hashing.fnv1a64(F.concat(F.lit(f"{key}:"), name))
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    return F.concat(pick(firsts, hashing.modulo(h, len(firsts))), F.lit("_"), pick(lasts, hashing.divide_modulo(h, len(firsts), len(lasts))))


def assign_aliases(entities: DataFrame, key: str, explicit: DataFrame | None = None, firsts: tuple[str, ...] = FIRST, lasts: tuple[str, ...] = LAST) -> DataFrame:
    """entity, alias, generated. entities: entity, seen (a sortable place of its first appearance).

    explicit (entity, alias) wins. Of entities with one base name the n-th to appear gets the n-th of X, X_2, X_3... that
    is no explicit alias. Bases can't collide with each other, so each is numbered by itself.
    """
    one = entities.where("entity <> ''").groupBy(F.lower("entity").alias("entity")).agg(F.min("seen").alias("seen"))
    if explicit is None:
        given = one.select("entity", F.lit(None).cast("string").alias("alias")).where("1 = 0")
    else:
        given = explicit.groupBy(F.lower("entity").alias("entity")).agg(F.min("alias").alias("alias"))  # of several the smallest
    rest = one.join(given.select("entity"), "entity", "left_anti").withColumn("base", pseudonym(F.col("entity"), key, firsts, lasts))
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("seen", "entity")))
    taken = given.select(F.col("alias").alias("candidate")).distinct()
    blocked = taken.select(F.regexp_replace("candidate", "_[0-9]+$", "").alias("base")).groupBy("base").agg(F.count("*").alias("more"))
    sizes = rest.groupBy("base").agg(F.count("*").alias("size")).join(blocked, "base", "left")
    free = sizes.select("base", F.explode(F.sequence(F.lit(1), F.col("size") + F.coalesce("more", F.lit(0)))).alias("i"))
    free = free.withColumn("candidate", F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", F.col("i").cast("string")))).join(taken, "candidate", "left_anti")
    free = free.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("i")))
    made = rest.join(free, ["base", "n"]).select("entity", F.col("candidate").alias("alias"), F.lit(True).alias("generated"))
    return given.join(one.select("entity"), "entity", "left_semi").withColumn("generated", F.lit(False)).unionByName(made)


#: The columns of names in a table of records.
NAME_COLUMNS = ("N", "S", "E", "W", "OB name", "Dec name", "Leader")


def anonymize_table(df: DataFrame, key: str, columns: tuple[str, ...] = NAME_COLUMNS, order: Column | None = None, explicit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """df with the names in columns (those of them that it has) replaced under a key, and the aliases. Names get theirs in the
    order of their first appearance: by order, then by column. An empty key would make aliases that anyone can make again, so it is refused."""
    if not key:
        raise ValueError("the key of aliases is empty")
    found = [c for c in columns if c in df.columns]
    if not found:
        raise ValueError(f"none of the columns {list(columns)} is among {df.columns}")
    at = F.lit(0) if order is None else order
    each = df.select(F.posexplode(F.array(*(F.col(f"`{c}`").cast("string") for c in found))).alias("i", "entity"), at.alias("o"))
    aliases = assign_aliases(each.where("entity is not null").select("entity", F.struct("o", "i").alias("seen")), key, explicit)
    return anonymize_columns(df, found, aliases), aliases


def anonymize_columns(df: DataFrame, columns: list[str], aliases: DataFrame) -> DataFrame:
    """df with the names in columns replaced (in any case); empty cells stay. An error if no column is there."""
    found = [c for c in columns if c in df.columns]
    if not found:
        raise ValueError(f"none of the columns {columns} is among {df.columns}")
    for c in found:
        map_ = aliases.select(F.col("entity").alias("_e"), F.col("alias").alias("_a"))
        old = F.col(f"`{c}`")
        df = df.join(map_, F.lower(old) == F.col("_e"), "left").withColumn(c, F.when(F.coalesce(old, F.lit("")) != "", F.coalesce(F.col("_a"), old)).otherwise(old)).drop("_e", "_a")
    return df


def anonymize_record(record: Column, aliases: Column) -> Column:
    """The names of a record's player field replaced by a map of lower-cased names; %2B in a name counts as +, other text stays."""
    part = r"^(.*?(?:\||=|^)pn(?:\||%7C))(.*?)((?:\||%7C).*)$"
    head, names, tail = (F.regexp_extract(record, part, i) for i in (1, 2, 3))
    comma = F.when(names.contains("%2C"), "%2C").otherwise(",")
    new = F.transform(F.split(F.replace(names, F.lit("%2C"), F.lit(",")), ","), lambda n: F.coalesce(aliases[F.lower(F.replace(n, F.lit("%2B"), F.lit("+")))], n))
    joined = F.call_function("array_join", new, comma)
    return F.when(record.rlike(part), F.concat(head, joined, tail)).otherwise(record)


def _parts(text: Column, terms: list[str], ignore_case: bool) -> tuple[Column, Column]:
    """Matches in order, and what stands around them (one more)."""
    pattern = alternation(terms, ignore_case)
    return F.regexp_extract_all(text, F.lit(pattern), 1), F.split(text, pattern, -1)


def _literal_map(rules: dict[str, str], lower: bool) -> Column:
    return F.create_map(*(F.lit(x) for k, v in rules.items() for x in (k.lower() if lower else k, v)))


def replace_rules(text: Column, rules: dict[str, str]) -> Column:
    """Each term by its replacement in one pass: leftmost, longest first, no overlaps, case counts. For some hundreds of rules; terms.replace_terms() takes tables of them."""
    found, around = _parts(text, list(rules), False)
    new = F.transform(found, lambda m: _literal_map(rules, False)[m])
    return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), new), around, lambda a, g: F.concat(a, g)), "")


def mask_fixed(text: Column, rules: dict[str, str]) -> Column:
    """As replace_rules(), each replacement padded with blanks or cut to the length of what it stands for."""
    return replace_rules(text, {k: v[: len(k)].ljust(len(k)) for k, v in rules.items()})


def replace_aligned(line: Column, aliases: dict[str, str]) -> Column:
    """Names in a line replaced in any case; what that adds or saves in length is taken from the next gap of white space (a
    blank at least stays), so later columns keep their place. Only what is owed is carried on; the parts are joined once."""
    found, around = _parts(line, list(aliases), True)
    lookup = _literal_map(aliases, True)
    rest = F.slice(around, 2, F.greatest(F.size(around) - 1, F.lit(0)))

    def part(m: Column, g: Column) -> Column:
        new, bare = lookup[F.lower(m)], F.regexp_replace(g, r"^\s+", "")
        return F.struct(new.alias("new"), bare.alias("bare"), (F.length(g) - F.length(bare)).alias("gap"), (F.length(m) - F.length(new)).alias("owed"))

    def step(done: Column, x: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["debt"], F.lit(0)) + x["owed"]
        return F.concat(done, F.array(F.struct(F.when(x["gap"] > 0, F.greatest(x["gap"] + before, F.lit(1))).otherwise(0).alias("wide"), F.when(x["gap"] > 0, 0).otherwise(before).alias("debt"))))

    def joined(parts: Column) -> Column:
        start = F.array().cast("array<struct<wide: int, debt: int>>")
        gaps = F.aggregate(parts, start, step)
        tail = F.zip_with(parts, gaps, lambda x, y: F.concat(x["new"], F.repeat(F.lit(" "), y["wide"]), x["bare"]))
        return F.array_join(tail, "")

    parts = F.array(F.zip_with(found, rest, part))  # bound once, by a lambda
    return F.concat(F.element_at(around, 1), F.element_at(F.transform(parts, joined), 1))


def redact_terms(text: Column, terms: list[str], link: str = r"https?://tinyurl\.com/\S+") -> Column:
    return F.regexp_replace(F.regexp_replace(text, link, "[link]"), alternation(terms), "")


def extract_links(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, pos, link: all links of a text in order."""
    return df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("pos", "link"))


def rewrite_links(df: DataFrame, key: str, text: str, pattern: str, known: DataFrame) -> DataFrame:
    """df with the links in text that known (link, target) has replaced by their targets, & escaped; others stay.

    Links are joined, not put in a pattern, so known may be large. pattern has the link as group 1, between a fixed head and tail.
    """
    links = extract_links(df, key, text, pattern).join(known, "link", "left")
    new = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce(F.regexp_replace("target", "&", "&amp;"), "link").alias("to")))).alias("_new"))
    head, tail = pattern.split("(", 1)[0], pattern.rsplit(")", 1)[1]
    around = F.split(F.col(text), f"(?<={head})" + "(?:" + pattern.split("(", 1)[1].rsplit(")", 1)[0] + ")" + f"(?={tail})", -1)
    joined = F.array_join(F.zip_with(F.concat(F.array(F.lit("")), F.transform("_new", lambda x: x["to"])), around, lambda a, g: F.concat(a, g)), "")
    return df.join(new, key, "left").withColumn(text, F.when(F.col("_new").isNull(), F.col(text)).otherwise(joined)).drop("_new")


def label_links(links: DataFrame, key: str, known: DataFrame, label: str = "Hand") -> DataFrame:
    """Mapped links of a document numbered in order: label 1, label 2, ..."""
    rows = links.join(known.select("link").distinct(), "link", "left_semi")
    return rows.withColumn("label", F.concat(F.lit(f"{label} "), F.row_number().over(Window.partitionBy(key).orderBy("pos"))))


def derive_alias_map(originals: DataFrame, replaced: DataFrame, columns: list[str]) -> DataFrame:
    """entity, alias from two tables with equal row_id: pairs of cells that differ and aren't empty; the first row wins."""
    pairs = originals.select("row_id", *(F.col(c).alias(f"_o{c}") for c in columns)).join(replaced.select("row_id", *(F.col(c).alias(f"_n{c}") for c in columns)), "row_id")
    each = pairs.select("row_id", F.posexplode(F.array(*(F.struct(F.lower(f"_o{c}").alias("entity"), F.col(f"_n{c}").alias("alias")) for c in columns))).alias("i", "x")).select("row_id", "i", "x.*")
    each = each.where("entity <> '' and alias <> '' and entity <> lower(alias)")
    return each.groupBy("entity").agg(F.min_by("alias", F.struct("row_id", "i")).alias("alias"))


def case_variants(pairs: DataFrame) -> DataFrame:
    """Each pair also in lower, upper and title case."""
    forms = F.array(*(F.struct(f("entity").alias("entity"), F.col("alias")) for f in (F.col, F.lower, F.upper, F.initcap)))
    return pairs.select(F.explode(forms).alias("x")).select("x.*").distinct()


def rewrite_map_values(known: DataFrame, aliases: dict[str, str] | DataFrame, value: str = "target", key: str | None = None) -> DataFrame:
    """known with the names in value replaced in one pass, the longest first; + in a name or alias stands there as %2B.

    aliases as a dict becomes one pattern; as a table (entity, alias) it may be of any size, and key tells the rows of known apart."""
    if isinstance(aliases, DataFrame):
        from .terms import replace_terms

        plus = lambda c: F.replace(F.col(c), F.lit("+"), F.lit("%2B"))
        return replace_terms(known, key, value, aliases.select(plus("entity").alias("term"), plus("alias").alias("replacement")))
    escaped = {k.replace("+", "%2B"): v.replace("+", "%2B") for k, v in aliases.items()}
    return known.withColumn(value, replace_rules(F.col(value), escaped))


def alias_lines(aliases: DataFrame, header: str = "# old=new") -> DataFrame:
    """line_no, line: an alias map as text, a comment first, then entity=alias in order of entity."""
    from .keys import with_row_id

    rows = with_row_id(aliases.select("entity", "alias"), "entity", "alias")
    lines = rows.select((F.col("row_id") + 1).alias("line_no"), F.concat_ws("=", "entity", "alias").alias("line"))
    return aliases.sparkSession.createDataFrame([(1, header)], "line_no long, line string").unionByName(lines)


def write_alias_map(aliases: DataFrame, path: str, header: str = "# old=new", mode: str = "append") -> None:
    """Numbered text parts in order of entity, a comment first, with a manifest."""
    from ..sources.parts import write_parts

    lines = aliases.select("entity", "alias", F.concat_ws("=", "entity", "alias").alias("line"))
    write_parts(lines, ["entity", "alias"], "line", path, header, mode=mode)


def fuzzy_tag(tokens: DataFrame, terms: DataFrame, share: float = 0.75) -> DataFrame:
    """Distinct token, term pairs that match by fuzzy_match().

    Of the first m letters, m the shorter length, u = m - ceil(share m) may differ. Cut into u + 1 blocks, one of them is
    equal, so tokens and terms meet by (m, block, letters): an equi-join on keys of several letters, never all pairs.
    """
    def keyed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(name).distinct().withColumn("low", F.lower(name))
        m = F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.length("low") - i), lambda x: x > 0))
        rows = rows.withColumn("m", m).withColumn("blocks", (F.col("m") - F.ceil(F.col("m") * share - 1e-9) + 1).cast("int"))
        cut = lambda i: F.floor(i * F.col("m") / F.col("blocks")).cast("int")
        block = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(i.alias("i"), F.substring(F.col("low"), cut(i) + 1, cut(i + 1) - cut(i)).alias("letters")))
        return rows.select(name, "m", F.explode(block).alias("block"))

    pairs = keyed(tokens, "token").join(keyed(terms, "term"), ["m", "block"]).where(F.col("m") == F.least(F.length(F.lower("token")), F.length(F.lower("term"))))
    return pairs.where(fuzzy_match(F.col("token"), F.col("term"), share)).select("token", "term").distinct()
