"""The memory as a whole over a small folder."""

import json

import pytest

from quarry import cli
from quarry.operators.memory import Config, Memory
from quarry.sources import files

CORPUS = {
    "app/cache.py": 'from app.config import CacheConfig\n\n\nclass CacheStore:\n    """Keeps keys."""\n\n    def evict_keys(self, limit):\n        return drop_expired(limit, CacheConfig)\n',
    "app/config.py": "class CacheConfig:\n    size = 10\n",
    "tests/test_cache.py": "from app.cache import CacheStore\n\n\ndef test_evict():\n    make_store(CacheStore).evict_keys(3)\n",
    "app/ledger.py": "def carry_rounding(total):\n    # what rounding leaves is carried to the next ledger page\n    return split_cents(total)\n",
    "tests/test_ledger.py": "def test_carry_rounding():\n    # what rounding leaves is carried to the next ledger page\n    pass\n",
    "noise/one.py": "def filler():\n    return 'plain'\n",
    "noise/two.go": "package noise\n\nfunc Other() int {\n\treturn 2\n}\n",
}


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("corpus")
    for path, body in CORPUS.items():
        (home / path).parent.mkdir(parents=True, exist_ok=True)
        (home / path).write_text(body)
    files.build(files.crawl(spark, f"file://{home}")).save(f"file://{home}/.store")
    m = Memory(files.Index.load(spark, f"file://{home}/.store"))
    m.home = home
    return m


def paths(df, by="rank"):
    return [r.path for r in df.orderBy(by).collect()]


def test_search_ranks_sources_before_tests(memory):
    assert paths(memory.search("rounding carried to the ledger page"))[0] == "app/ledger.py"
    assert paths(memory.search("CacheStore evict_keys"))[0] in ("app/cache.py", "tests/test_cache.py")
    assert memory.search("zzzz unmatched").count() == 0


def test_search_follows_symbols_and_several_query_paths(memory, monkeypatch):
    """A file that full text doesn't find is led to by its symbols, and each part of the search is used."""
    from quarry.operators import candidates, retrieval

    q = "cachesto"  # part of a name: no token of any text
    assert {"app/cache.py", "tests/test_cache.py"} & set(paths(memory.search(q)))
    monkeypatch.setattr(candidates, "structured_paths", lambda s, r, i, limit: s.select("query_id", "path", "rank").limit(0))
    assert memory.search(q).count() == 0
    used = []
    for module, name in ((candidates, "best_path_ranks"), (retrieval, "bm25f"), (candidates, "structured_boost")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: used.append(_n) or _f(*a, **k))
    memory.search("evict keys")
    assert set(used) == {"best_path_ranks", "bm25f", "structured_boost"}


def test_repair_and_validation_merge(memory, monkeypatch):
    from quarry.operators import candidates, graph

    used = []
    for module, name in ((candidates, "merge_snippets"), (graph, "merge_commands")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: used.append(_n) or _f(*a, **k))
    assert memory.repair_pack('File "app/config.py", line 1, in size').orderBy("place").head().path == "app/config.py"
    got = memory.validation(["app/cache.py", "noise/two.go"], Config({"go": "make check"})).collect()
    assert got[0].command.startswith("make check") and any(r.command.startswith("python -m pytest") for r in got) and len({r.command for r in got}) == len(got)
    assert used == ["merge_snippets", "merge_commands"]


def test_reranker_hook(memory):
    from pyspark.sql import functions as F

    last = paths(memory.search("evict keys cache"))[-1]
    m = Memory(memory.index, reranker=lambda df: df.select("id", F.when(F.col("path") == last, 1).otherwise(99).alias("place")))
    assert paths(m.search("evict keys cache")).index(last) < len(paths(memory.search("evict keys cache"))) - 1 or len(paths(m.search("evict keys cache"))) == 1


def test_pack_keeps_budget_and_adds_a_neighbour(memory):
    got = memory.pack("evict keys in CacheStore", "debug", 4, 4096).collect()
    assert "app/cache.py" in {r.path for r in got} and max(r.used_bytes for r in got) <= 4096
    assert not any(r.path.startswith("noise") for r in got)


def test_graph_rows_are_of_every_kind(memory):
    seeds = memory.corpus().filter("path = 'app/cache.py'").selectExpr("1L query_id", "id", "path", "text")
    got = {r.path: r for r in memory.graph_rows(seeds, "debug").collect()}
    assert set(got) == {"app/config.py", "tests/test_cache.py"}
    assert "type that a hit names" in got["app/config.py"].reasons and "imported by app/cache.py" in got["app/config.py"].evidence
    assert {"call of what a hit defines", "resolved local import graph"} <= set(got["tests/test_cache.py"].reasons)
    assert got["tests/test_cache.py"].place == 1  # tests come first
    assert "call of what a hit defines" not in {x for r in memory.graph_rows(seeds).collect() for x in r.reasons}


def test_pack_takes_the_graph_by_mode(memory, monkeypatch):
    alone = lambda mode: {r.path for r in memory.pack("evict_keys limit drop_expired", mode, 3, 8000).collect()}
    assert "app/config.py" not in alone("docs") and {"app/config.py", "tests/test_cache.py"} <= alone("debug")
    monkeypatch.setattr(Memory, "graph_rows", lambda self, seeds, mode="": seeds.limit(0).selectExpr("query_id", "id", "path", "text", "'' topic", "1 place", "array('') reasons", "array('') evidence", "0.0D confidence"))
    assert "app/config.py" not in alone("debug")


def test_diagnose(memory, tmp_path):
    import sys

    assert memory.diagnose(f"{sys.executable} -c pass").verdict == "passed"
    script = tmp_path / "fails.py"
    script.write_text("print('Traceback (most recent call last):\\n  File \"app/cache.py\", line 8, in evict_keys\\nNameError: drop_expired')\nraise SystemExit(3)\n")
    got = memory.diagnose(f"{sys.executable} {script}")
    assert (got.verdict, got.ran.code) == ("failed", 3) and got.frames.head().path == "app/cache.py"
    assert got.pack.orderBy("place").head().path == "app/cache.py"
    slow = memory.diagnose(f"{sys.executable} -c 'import time; print(1, flush=True); time.sleep(60)'", seconds=1)
    assert slow.verdict == "stopped" and slow.pack is None and "stopped after 1 s" in slow.ran.output
    assert memory.diagnose("no-such-command-anywhere").verdict == "not run"
    ran = memory.validate(["app/cache.py"], Config({"py": f"{sys.executable} {script}"}), seconds=30)
    assert [d.verdict for d in ran] == ["failed"]


def test_repair_pack_leads_with_the_frame(memory):
    out = 'Traceback (most recent call last):\n  File "app/cache.py", line 8, in evict_keys\nNameError: name \'drop_expired\' is not defined'
    assert memory.repair_pack(out).orderBy("place").head().path == "app/cache.py"


def test_graph_and_affected(memory):
    g = memory.dependency_graph("app/cache.py")
    assert [r.target_path for r in g["imports"].collect()] == ["app/config.py"]
    assert [r.path for r in g["imported_by"].collect()] == ["tests/test_cache.py"]
    assert "tests/test_cache.py" in {r.path for r in g["referenced_by"].collect()}
    assert memory.affected(["app/cache.py"]).head().path == "tests/test_cache.py"
    assert memory.validation(["app/cache.py"]).head().command.startswith("python -m pytest")
    assert set(memory.report(["app/cache.py"])) == {"affected", "validation", "pack"}
    assert "app/config.py" in paths(memory.related("app/cache.py"))


def test_metadata(memory):
    found, used = memory.symbol_context("CacheStore", 5)
    assert found.orderBy("rank").head().name == "CacheStore"
    assert used.count() >= 0 and memory.import_context("config").head().path == "app/cache.py"
    assert {"symbol", "import"} & {r.kind for r in memory.cards("cache").collect()}
    assert memory.repo_map().count() >= 4


def test_audit_and_stats(memory):
    got = {r.check: r.status for r in memory.audit(Config(ignore=["x"])).collect()}
    assert got == {"secrets": "pass", "index": "pass", "ignore": "pass"}
    assert {r["table"]: r.n for r in memory.stats().collect()}["files"] == len(CORPUS)


def test_config():
    c = Config.parse('[validation]\npython = "make test"\n[index]\nignore = ["a/"]\n')
    assert c.validation == {"py": "make test"} and c.ignore == ["a/"]
    assert Config.parse(Config.STARTER).validation == {}


def test_command_line(memory, capsys):
    assert cli.main(["stats", f"file://{memory.home}/.store"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {r["table"] for r in rows} >= {"files", "knowledge"}


def test_rpc_loop(memory):
    import io

    from quarry import rpc

    asks = [{"id": 1, "method": "initialize"}, {"method": "notifications/ready"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "stats"}}, {"id": 4, "method": "tools/call", "params": {"name": "graph", "arguments": {"path": "app/cache.py"}}}, {"id": 5, "method": "nope"}, {"id": 6, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "evict keys", "limit": "x"}}}]
    out = io.StringIO()
    rpc.serve(memory, io.StringIO("\n".join(map(json.dumps, asks)) + "\nnot json\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert set(got) == {1, 2, 3, 4, 5, 6, None} and len(got[2]["result"]["tools"]) == 14
    assert got[4]["result"]["imports"][0]["target_path"] == "app/config.py"
    assert all("error" in got[k] for k in (5, 6, None))
