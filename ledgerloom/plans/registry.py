"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from ledgerloom.plans import credit, extracts, general, intake, labels, papers, records, statements

MODULES = [credit, extracts, general, intake, labels, papers, records, statements]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
