"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from . import cases, exchange, ingest, keys, listing, rates, reports, sequences, terms, texts

MODULES = (rates, keys, sequences, texts, reports, cases, exchange, terms, ingest, listing)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
