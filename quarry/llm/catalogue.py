"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
SQL: dict = {}
for _name in (
    "op1_warc",
    "op2_quality",
    "op3_bpe",
    "op4_decontam",
    "op5_omh",
    "op6_secrets",
    "op7_substrings",
    "op8_shards",
    "op9_neardup",
    "op10_counts",
    "op11_packing",
    "op12_sort_means",
    "op13_merkle",
):
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
