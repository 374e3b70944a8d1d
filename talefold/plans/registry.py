"""All registered queries and their SQL."""

from __future__ import annotations

from . import catalog, nested, notes, operations, records, transcripts

MODULES = (transcripts, notes, operations, catalog, records, nested)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
