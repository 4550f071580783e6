"""All registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

_MODULES = [
    ("citation_queries", "oracle_citations"),
    ("text_queries", "oracle_text"),
    ("retrieval_queries", "oracle_retrieval"),
    ("app_queries", "oracle_app"),
]


def queries() -> dict:
    """All registered queries by name."""
    out = {}
    for qmod, _ in _MODULES:
        out.update(importlib.import_module(f"{__package__}.{qmod}").QUERIES)
    return out


def oracle_sql() -> dict:
    """DuckDB SQL for every query that has one."""
    out = {}
    for _, smod in _MODULES:
        if smod:
            out.update(importlib.import_module(f"{__package__}.{smod}").SQL)
    return out
