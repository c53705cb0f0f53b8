"""Text forms: names, calls, contracts, hands, and comparisons of terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = "23456789TJQKA"


def quoted(term: str) -> str:
    """term as a pattern that matches itself only."""
    return "".join(c if c.isalnum() or ord(c) > 127 or c in " _" else "\\" + c for c in term)


def alternation(terms: list[str], ignore_case: bool = False) -> str:
    """Leftmost, then longest: the longer term stands first."""
    body = "|".join(quoted(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return f"{'(?i)' if ignore_case else ''}({body})"


def short_name(name: Column) -> Column:
    """Up to the first underscore, with dots for the rest."""
    return F.when(F.instr(name, "_") > 0, F.concat(F.substring_index(name, "_", 1), F.lit("..."))).otherwise(name)


def clip_name(name: Column, width: int) -> Column:
    return F.when(F.length(name) > width, F.concat(F.substring(name, 1, width - 3), F.lit("..."))).otherwise(name)


def norm_contract(contract: Column) -> Column:
    """Without the seat that may end it."""
    return F.regexp_replace(F.trim(contract), r"^(\d.+)[NSEWnsew]$", "$1")


def trump_of(contract: Column) -> Column:
    """NT, S, H, D or C; NULL if there is none. A closing seat doesn't count."""
    bid = F.upper(norm_contract(contract))
    suit = F.regexp_extract(bid, "[SHDC]", 0)
    return F.when(bid.contains("NT") | (bid.contains("N") & ~bid.contains("S")), "NT").when(suit != "", suit)


def norm_call(call: Column) -> Column:
    bare = F.upper(F.regexp_replace(call, "!", ""))
    return F.when(bare == "P", "pass").when(bare == "D", "X").when(bare == "R", "XX").otherwise(F.regexp_replace(bare, "^([1-7])N$", "$1NT"))


def contract_of(calls: Column) -> Column:
    """The last bid of an auction, with x or xx as the calls after it say; Passed Out without a bid."""
    plain = F.transform(calls, lambda c: F.upper(F.regexp_replace(c, "!", "")))
    bids = F.filter(F.transform(plain, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: s["c"].rlike("^[1-7]"))
    last = F.try_element_at(bids, F.lit(-1))
    later = F.filter(F.transform(plain, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda s: s["i"] > last["i"])
    has = lambda *names: F.exists(later, lambda s: s["c"].isin(*names))
    return F.when(F.size(bids) <= 0, "Passed Out").otherwise(F.concat(last["c"], F.when(has("R", "XX"), "xx").when(has("D", "X", "DBL"), "x").otherwise("")))


def suit_cards(hand: Column, suit: str) -> Column:
    """Cards of a suit in a hand like S-K85 H-873 D-Q75 C-K3; - for none."""
    got = F.regexp_extract(hand, rf"(?:^|\s){suit}-([^\s]*)", 1)
    return F.when(got != "", got).otherwise("-")


def hand_to_dots(hand: Column) -> Column:
    """S-.. H-.. D-.. C-.. as ranks with dots between, NULL for another form."""
    groups = F.split(F.trim(hand), r"\s+")
    good = (F.size(groups) == 4) & F.forall(F.transform(groups, lambda g, i: g.startswith(F.concat(F.substring(F.lit("SHDC"), i + 1, F.lit(1)), F.lit("-")))), lambda x: x)
    return F.when(good, F.array_join(F.transform(groups, lambda g: F.substring(g, F.lit(3), F.length(g))), "."))


def cards_of(hand: Column) -> Column:
    """S23JH45... as an array of suit and rank pairs."""
    start = F.struct(F.lit("").alias("suit"), F.array().cast("array<string>").alias("cards"))
    step = lambda a, c: F.when(c.isin("S", "H", "D", "C"), F.struct(c.alias("suit"), a["cards"].alias("cards"))).otherwise(F.struct(a["suit"].alias("suit"), F.concat(a["cards"], F.array(F.concat(a["suit"], c))).alias("cards")))
    return F.aggregate(F.filter(F.split(F.upper(hand), ""), lambda c: c != ""), start, step, lambda a: a["cards"])


def board_no(header: Column) -> Column:
    return F.try_element_at(F.split(F.trim(header), r"\s+"), F.lit(-1)).try_cast("int")


def vulnerability(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in ("o", "None", "n", "NS", "e", "EW", "b", "Both")))[F.lower(code)]


def dealer(digit: Column) -> Column:
    return F.create_map(*(F.lit(x) for x in ("1", "S", "2", "W", "3", "N", "4", "E")))[digit]


def fuzzy_match(a: Column, b: Column, share: float = 0.75) -> Column:
    """Equal but for case; or lengths that differ by 2 at most, b longer than 3, and that share of equal places in the shorter one."""
    x, y = F.lower(a), F.lower(b)
    same = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.coalesce((p == q) & (p != ""), F.lit(False)).cast("int")), F.lit(0), lambda t, v: t + v)
    near = (F.abs(F.length(x) - F.length(y)) <= 2) & (F.length(y) > 3)
    return (x == y) | (near & (same / F.greatest(F.least(F.length(x), F.length(y)), F.lit(1)) >= share))


def declarer_level(won: Column, left: Column, to_come: Column, own: Column) -> Column:
    """Tricks for the declaring side: those won and, of those left, what the side on play (own: the declaring one) takes as to_come."""
    return won + F.when(own, to_come).otherwise(left - to_come)


def is_declaring(seat: Column, declarer: Column) -> Column:
    """Whether a seat (0 to 3) is the declarer's or the one across."""
    return F.pmod(seat - declarer, F.lit(2)) == 0
