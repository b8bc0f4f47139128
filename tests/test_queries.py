"""Every query with SQL against DuckDB on the smallest tables; the others run and have rows."""

import os

import pytest

import __spark_entry__ as entry
from quarry.plans import catalogue

from .oracle import spark_rows, sql_rows, views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = spark_rows(catalogue.QUERIES[name](spark, SF))
    if name in catalogue.SQL:
        assert got == sql_rows(duck, catalogue.SQL[name])
    else:
        assert got[1]


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_llm_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{home}/quarry", tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{home}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not [n for n in q if n.startswith('op') and n[2:3].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_plans_prune_and_push_down(spark):
    """A scan reads the columns and rows it needs, and top-k is cut before the shuffle."""
    plan = lambda n: catalogue.QUERIES[n](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<lang:string>" in plan("language_stats")
    assert "WindowGroupLimit" in plan("bm25_topk")
    assert "CartesianProduct" not in plan("related_scores") and "BroadcastNestedLoopJoin" not in plan("import_resolution")
