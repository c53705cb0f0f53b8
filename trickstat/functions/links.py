"""Keys and parts of links and of records that links carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def link_key(url: Column, host: str = "tinyurl.com") -> Column:
    """What follows the short-link host, lower-cased and without closing slashes; the whole link if it is elsewhere."""
    low = F.lower(F.regexp_replace(F.trim(url), "/+$", ""))
    at = F.instr(low, f"{host}/")
    return F.when(at > 0, F.substring(low, at + len(host) + 1, F.length(low))).otherwise(low)


def to_https(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "^http://", "https://")


def percent_decode(text: Column) -> Column:
    """%XX as bytes of UTF-8; other percent signs and plus signs stay."""
    safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), text)


def _open(record: Column, *codes: str) -> Column:
    for code, char in (("7C", "|"), ("2C", ","), ("2B", "+")):
        if char in codes:
            record = F.regexp_replace(record, f"(?i)%{code}", "\\" + char if char != "," else ",")
    return record


def deal_key(record: Column) -> Column:
    """The deal of a record, lower-cased: what identifies a hand whatever its link; NULL if there is none."""
    return F.lower(F.nullif(F.regexp_extract(_open(record, "|", ","), r"\|md\|([^|]*)\|", 1), F.lit("")))


def players_of(record: Column) -> Column:
    """The four names of a record (S, W, N, E), NULL if there are fewer."""
    names = F.split(F.regexp_extract(_open(record, "|", ",", "+"), r"(?:\||=|^)pn\|([^|]*)\|", 1), ",")
    return F.when(F.size(names) >= 4, F.slice(names, 1, 4))
