"""All queries of the library by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import analytics, catalogs, forms, harmonisation, histories, linkage, path, procurement, records

_PARTS = [procurement, analytics, harmonisation, records, catalogs, linkage, histories, forms, path]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: text for part in _PARTS for name, text in part.ORACLE_SQL.items()}
