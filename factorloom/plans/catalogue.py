"""All queries of the library and their SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _name in ("scoring", "reports", "series", "fundamentals", "records", "backtests", "proposals", "cycle"):
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
