"""A line-delimited JSON-RPC loop over a memory (S23, T05): read-only tools, one request a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from .operators.memory import Memory

_TEXT = {"query": "string", "limit": "integer"}
TOOLS = {
    "search": _TEXT | {"mode": "string"},
    "context_pack": _TEXT | {"mode": "string", "budget": "integer"},
    "repair_pack": {"output": "string", "query": "string", "limit": "integer"},
    "affected_tests": {"paths": "array", "limit": "integer"},
    "validation_plan": {"paths": "array"},
    "map": {"limit": "integer"},
    "symbols": _TEXT,
    "references": _TEXT,
    "imports": _TEXT,
    "cards": _TEXT,
    "graph": {"path": "string"},
    "related": {"path": "string", "limit": "integer"},
    "stats": {},
    "audit": {},
}


def call(memory: Memory, tool: str, a: dict) -> object:
    q, n = a.get("query", ""), int(a.get("limit", 5))
    rows = lambda df: [r.asDict(recursive=True) for r in df.toLocalIterator()]
    made: dict[str, Callable[[], object]] = {
        "search": lambda: rows(memory.search(q, a.get("mode", ""), n)),
        "context_pack": lambda: rows(memory.pack(q, a.get("mode", ""), n, int(a.get("budget", 0)))),
        "repair_pack": lambda: rows(memory.repair_pack(a.get("output", ""), q, n)),
        "affected_tests": lambda: rows(memory.affected(list(a.get("paths", [])), n)),
        "validation_plan": lambda: rows(memory.validation(list(a.get("paths", [])))),
        "map": lambda: rows(memory.repo_map(n)),
        "symbols": lambda: rows(memory.symbol_context(q, n)[0]),
        "references": lambda: rows(memory.symbol_context(q, n)[1]),
        "imports": lambda: rows(memory.import_context(q, n)),
        "cards": lambda: rows(memory.cards(q, n)),
        "graph": lambda: {k: rows(v) for k, v in memory.dependency_graph(a.get("path", "")).items()},
        "related": lambda: rows(memory.related(a.get("path", ""), n)),
        "stats": lambda: rows(memory.stats()),
        "audit": lambda: rows(memory.audit()),
    }
    return made[tool]()


def answer(memory: Memory, request: dict) -> dict | None:
    """None for notifications, which have no id."""
    number, method, params = request.get("id"), request.get("method"), request.get("params") or {}
    said: dict
    if method == "initialize":
        said = {"result": {"name": "quarry", "capabilities": {"tools": {}}}}
    elif method == "tools/list":
        said = {"result": {"tools": [{"name": k, "inputSchema": {"type": "object", "properties": {p: {"type": t} for p, t in v.items()}}} for k, v in TOOLS.items()]}}
    elif method == "tools/call" and params.get("name") in TOOLS:
        try:
            said = {"result": call(memory, params["name"], params.get("arguments") or {})}
        except Exception as e:  # a tool's failure is the caller's answer, not the loop's end
            said = {"error": {"code": -32000, "message": str(e)[:500]}}
    else:
        said = {"error": {"code": -32601, "message": f"unknown: {method} {params.get('name', '')}".strip()}}
    return None if number is None else {"jsonrpc": "2.0", "id": number} | said


def serve(memory: Memory, given: IO[str] = sys.stdin, out: IO[str] = sys.stdout) -> None:
    for line in given:
        if not line.strip():
            continue
        try:
            reply = answer(memory, json.loads(line))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply, default=str), file=out, flush=True)
