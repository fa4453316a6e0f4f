"""All registered queries and their checks."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ledger_queries", "inbox_queries", "message_queries", "token_queries", "storage_queries", "screen_queries")


def _load():
    registry = import_module("passbook.catalog.registry")
    for name in MODULES:
        import_module(f"passbook.catalog.{name}")
    return registry


def queries() -> dict:
    return dict(_load().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_load().ORACLES)
