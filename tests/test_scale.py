"""What the plans do with skew and size: partial aggregates first, no collected groups, top-k before shuffles."""

import os

import pytest

from quarry.operators import graph, retrieval, store
from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_is_one_partial_aggregate(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "user_id long, kind string, v double")
    p = plan(store.latest(df, ["user_id", "kind"], "v"))
    assert "partial_max_by" in p and p.count("Exchange") == 1


def test_diff_shuffles_keys_and_stamps_only(spark):
    old = spark.createDataFrame([(1, "h", "long text")], "path long, content_hash string, text string")
    p = plan(store.snapshot_diff(old, old.filter("path > 0"), "path", "content_hash"))
    assert "text" not in p.split("Exchange", 1)[0]


def test_suffix_joins_are_equi_joins(spark):
    e = spark.createDataFrame([("a", 1, ["b.py"])], "path string, line int, candidates array<string>")
    p = plan(graph.resolve_imports(e, spark.createDataFrame([("x/b.py",)], "path string")))
    assert "NestedLoop" not in p and "Cartesian" not in p


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", ["bm25_topk", "identifier_tokens", "line_windows", "import_resolution", "related_scores", "keep_latest", "query_intent", "call_sites"])
def test_hot_paths_stay_in_the_jvm(spark, name):
    p = plan(catalogue.QUERIES[name](spark, SF))
    assert "Python" not in p and "Cartesian" not in p


def test_bm25_semi_joins_before_it_groups(spark):
    c = spark.createDataFrame([(1, "cache store")], "id long, text string")
    q = spark.createDataFrame([(1, "cache")], "query_id long, text string")
    p = plan(retrieval.postings(c, retrieval.query_tokens(q)))
    assert "LeftSemi" in p
