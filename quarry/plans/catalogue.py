"""Every query of the library, with its SQL."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
SQL: dict = {}
for _name in ("retrieval", "texts", "graph", "evaluate", "packs", "metadata", "code", "scans", "measures", "merged"):
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
