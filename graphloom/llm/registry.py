"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Modules with QUERIES and, where SQL can express the query, SQL.
MODULES = (
    "url_filters",
    "license_scan",
    "packing",
    "decontaminate",
    "jaccard_join",
    "topk_search",
    "substring_dedup",
    "suffix_dedup",
    "quality",
    "pii",
)


def _all(what: str) -> dict:
    out = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{name}"), what, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
