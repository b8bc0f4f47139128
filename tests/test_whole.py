"""Queries of the names in _all are over all rows."""

import os

import pytest

from quarry.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def ran(spark, name):
    return catalogue.QUERIES[name](spark, SF)


def test_every_part_has_its_frames(spark):
    parts = {r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()}
    assert {r.failure_id for r in ran(spark, "repair_frames_all").select("failure_id").collect()} == parts


def test_every_definition_and_call_site_is_looked_up(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").selectExpr("split_part(p_name, ' ', 1) n", "concat('a/', p_brand) a", "concat('b/', p_type) b", "p_partkey k").collect()
    assert {(r.def_name, r.def_path) for r in ran(spark, "callers_all").collect()} == {(r.n, r.a) for r in part}
    assert {(r.ref_name, r.ref_path, r.ref_line) for r in ran(spark, "definitions_all").collect()} == {(r.n.upper(), r.b, r.k) for r in part}


def test_every_test_file_counts_as_changed(spark):
    from quarry.plans.graph import files

    tests = {r.path for r in files(spark, SF).filter("path like '%/test_m%'").collect()}
    assert {r.path for r in ran(spark, "affected_paths_all").filter("reasons like '%changed test%'").collect()} == tests


@pytest.mark.parametrize("name", ["repair_frames_all", "callers_all", "definitions_all", "affected_paths_all"])
def test_sql_has_no_subset(name):
    import re

    assert not re.findall(r"% (?:10|20|97) = 0", catalogue.SQL[name])


def test_callers_and_definitions_by_brute_force(spark):
    """Few keys, shared paths, so that whole paths are left out."""
    import random

    from quarry.operators import graph as G

    r = random.Random(5)
    d = [(r.choice("ab"), r.choice(["class", "function", "method"]), r.choice(["py", "go"]), r.choice("xyz"), k) for k in range(80)]
    c = [(r.choice("AB"), r.choice(["py", "go"]), r.choice("xyz"), k) for k in range(80)]
    defs, refs = spark.createDataFrame(d, "name string, kind string, language string, path string, line int"), spark.createDataFrame(c, "name string, language string, path string, line int")
    got = sorted((x.def_name, x.def_path, x.place, x.def_language, x.path, x.line) for x in G.callers(defs, refs).collect())
    want = []
    for name, path in {(x[0], x[3]) for x in d}:
        rows = sorted((b[1] != a[2], b[2], b[3], a[2]) for a in d for b in c if a[0] == name and a[3] == path != b[2] and b[0].lower() == name)
        want += [(name, path, n + 1, x[3], x[1], x[2]) for n, x in enumerate(rows[:8])]
    assert got == sorted(want)
    got = sorted((x.ref_line, x.place, x.kind, x.path, x.line) for x in G.definitions_of(refs, defs).collect())
    order, want = ["class", "function", "method"], []
    for b in c:
        rows = sorted((a[2] != b[1], order.index(a[1]), a[3], a[4]) for a in d if a[0] == b[0].lower() and a[3] != b[2])
        want += [(b[3], n + 1, order[x[1]], x[2], x[3]) for n, x in enumerate(rows[:8])]
    assert got == sorted(want)


def test_holders_are_found_in_all_documents(spark):
    """Passages that begin or end within words, without inner tokens, held by documents that BM25 marks down, by none."""
    from quarry.operators import evaluate as V

    q = [(1, "ache store evicts ke"), (2, "x"), (3, "Store Evicts"), (4, "not there at all"), (5, "a1 İb c, store"), (6, None), (7, "?!")]
    c = [(1, "The cache store evicts keys"), (2, "the Store Evicts " + "filler " * 2000), (3, "xa1 İb c, stores ?!"), (4, None), (5, "store evicts"), (6, "not there"), (7, "cache store evicts ke")]
    got = V.holders(spark.createDataFrame(q, "query_id int, text string"), spark.createDataFrame(c, "id int, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, k) for i, a in q for k, b in c if a is not None and b is not None and a in b)


def test_items_without_a_candidate_are_misses(spark, tmp_path):
    """One holder, so long that the short documents with the item's words fill the candidates."""
    from quarry.plans import evaluate as E

    item = "zebra quartz violin harbor"
    docs = [(1, "filler words here " * 4000 + item)] + [(k, "harbor violin quartz zebra") for k in range(2, 60)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.query_id, r.gold_rank, r.rr) for r in E.QUERIES["eval_cases_all"](spark, str(tmp_path)).collect()] == [(1, None, 0.0)]
