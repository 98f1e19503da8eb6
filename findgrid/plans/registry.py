"""All queries of the library, by name, with their DuckDB SQL."""

from __future__ import annotations

from findgrid.plans import queries_code, queries_deps, queries_exchange, queries_findings, queries_misc, queries_more, queries_pages, queries_recon, queries_search, queries_secrets, queries_web

_MODULES = (queries_findings, queries_code, queries_deps, queries_web, queries_recon, queries_exchange, queries_misc, queries_more, queries_pages, queries_search, queries_secrets)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
FLAGSHIP = "rule_scan_severity"
