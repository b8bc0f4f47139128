"""Refresh, streamed upserts, packing of blocks, subsequences, searches by pieces: against plain versions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.functions import distance
from quarry.operators import metadata
from quarry.sources import chunks, files
from quarry.streaming import incremental


def written(folder, **texts):
    for name, content in texts.items():
        path = folder / name.replace("__", "/").replace("_py", ".py")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)


def edges(index):
    return {(r.path, r.import_path): r.target_path for r in index.imports.collect()}


def test_refresh_resolves_all_imports_against_all_files(spark, tmp_path):
    import os

    written(tmp_path, app__a_py="def run():\n    return 1\n", app__b_py="import app.a\nimport app.c\n", app__d_py="import app.a\n")
    crawl = lambda: files.crawl(spark, f"file://{tmp_path}")
    index = files.build(crawl())
    assert edges(index) == {("app/b.py", "app.a"): "app/a.py", ("app/b.py", "app.c"): "", ("app/d.py", "app.a"): "app/a.py"}
    index.save(f"{tmp_path}/store")
    index = files.Index.load(spark, f"{tmp_path}/store")
    os.remove(tmp_path / "app/a.py")
    written(tmp_path, app__b_py="import app.a\nimport app.c\n\n", app__c_py="x = 1\n")
    os.utime(tmp_path / "app/b.py", (2_000_000_000, 2_000_000_000))
    again = files.refresh(index, crawl().filter("path not like 'store/%'"))
    assert edges(again) == {("app/b.py", "app.a"): "", ("app/b.py", "app.c"): "app/c.py", ("app/d.py", "app.a"): ""}
    assert files.refresh(index, crawl().limit(0)) is index


def test_upserts_keep_what_a_batch_lacks_and_go_on_after_a_restart(spark, tmp_path):
    schema = "key string, n long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    rows = lambda s: sorted(map(tuple, s.table().collect()), key=str)
    sink = incremental.Upserts(spark, f"file://{tmp_path}/t", ["key"], schema)
    assert rows(sink) == []
    sink(batch(("a", 1), ("a", 2), (None, 5)), 0)
    sink(batch(("b", 1)), 1)
    assert rows(sink) == sorted([("a", 2), ("b", 1), (None, 5)], key=str)
    fresh = incremental.Upserts(spark, f"file://{tmp_path}/t", ["key"], schema)
    fresh(batch(("b", 7)), 1)  # the same batch again, as after a lost commit
    fresh(batch(("c", 3), (None, 6)), 2)
    assert rows(fresh) == sorted([("a", 2), ("b", 7), ("c", 3), (None, 6)], key=str)
    assert fresh.versions() == [1, 2]


def test_blocks_are_packed_up_to_the_limit():
    code = "".join(f"def f{k}():\n    return {k}\n\n" for k in range(30)).encode()
    got = chunks.chunks("py", code, 200)
    assert b"".join(d for _, _, d in got) == code and all(len(d) <= 200 for _, _, d in got)
    assert all(len(a[2]) + 26 > 200 for a in got[:-1])  # the next block would not have fitted


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
def test_lcs_by_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    assert distance.lcs_length(a, b) == row[-1]


def test_search_by_containment(spark):
    """Every row that holds a token anywhere, however short, and no others."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcXY_1") for _ in range(r.randrange(1, 7)))
    rows = [(word(), f"p/{word()}", r.choice([word(), None]), k) for k in range(120)] + [("ab", "p", None, 7), ("ab", "p", None, 7)]
    queries = [(k, f"{word()} {word()}") for k in range(25)] + [(99, "")]
    columns = [("name", 6), ("path", 3), ("signature", 2)]
    got = metadata.search(spark.createDataFrame(rows, "name string, path string, signature string, line int"), spark.createDataFrame(queries, "query_id long, text string"), columns, 1000)
    from quarry.functions import text
    from pyspark.sql import functions as F

    tokens = {q.query_id: q.t[:16] for q in spark.createDataFrame(queries, "query_id long, text string").select("query_id", text.identifier_tokens(F.col("text")).alias("t")).collect()}
    want = []
    for q, ts in tokens.items():
        for name, path, sign, line in rows:
            score = 0
            for t in ts:
                low = [(name.lower(), 6), (path.lower(), 3), ((sign or "").lower(), 2)]
                score += 10 if low[0][0] == t else next((p for c, p in low if t in c), 0)
            if score:
                want.append((q, name, path, sign, line, score))
    assert sorted([(x.query_id, x.name, x.path, x.signature, x.line, x.score) for x in got.collect()], key=str) == sorted(want, key=str)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_ids_weigh_in_the_lead_as_in_the_sql_of_protected_first(spark):
    """1e-6 of the base score is 1,000 ids; larger tables have ids further apart."""
    import duckdb

    from quarry.operators import retrieval
    from quarry.plans.retrieval import leading_base

    rows = [(1, 40_000, 0.063001, 1, True), (1, 12, 0.063002, 2, True), (1, 7, 0.9, 3, False)]
    s = spark.createDataFrame(rows, "query_id long, id long, base double, rank int, primary boolean")
    want = duckdb.sql("select arg_min(id, base * 1000000000 + id) from (values (40000, 0.063001::double), (12, 0.063002::double)) t(id, base)").fetchall()[0][0]
    assert want == 12
    assert [r.id for r in retrieval.protected_first(leading_base(s), 3).orderBy("place").collect()] == [12, 40_000, 7]
    assert [r.id for r in retrieval.protected_first(s, 3).orderBy("place").collect()] == [40_000, 12, 7]


def test_candidates_meet_their_own_query_only(spark):
    """Jaccard of the candidates had every text meet the tokens of all queries; F12: all tokens of the texts were moved."""
    from pyspark.sql import functions as F

    from quarry.operators import retrieval

    q = spark.createDataFrame([(k, f"import alpha beta w{k} CacheStore{k}") for k in range(20)] + [(90, None), (91, "import zzz")], "query_id long, text string")
    rows = [(k, i, f"alpha w{i} cache_store{k} beta gamma{i} alpha") for k in range(20) for i in range(k, k + 5)] + [(90, 1, "alpha"), (91, 2, None), (91, 3, "other words")]
    c = spark.createDataFrame(rows, "query_id long, id long, text string")
    shown = lambda d, v: sorted((r.query_id, r.id, round(r[v], 9)) for r in d.collect())
    one = c.withColumn("id", F.col("query_id") * 1000 + F.col("id"))  # a text for each candidate, so that all pairs can be cut down to them
    got, all_pairs = retrieval.candidate_jaccard(q, one), retrieval.jaccard_scores(q, one.select("id", "text"))
    assert shown(got, "score") == shown(all_pairs.join(one.select("query_id", "id"), ["query_id", "id"]), "score") and got.count() == 100 < all_pairs.count()
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()
    boosts = metadata.exact_identifiers(q, c)
    plan = boosts._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(held") and plan.count("Generate") == 1
    best = {}
    for k, i, b in shown(boosts, "boost"):
        best.setdefault(k, []).append((b, i))
    assert sorted(best) == list(range(20)) and all(max(v) == (0.08, k) and len(v) == 5 for k, v in best.items())


def test_texts_stay_where_they_are_when_few_pairs_are_searched(spark, tmp_path, monkeypatch):
    """pairs of an item and a document that may hold it are sent to the texts."""
    from quarry.operators import evaluate

    monkeypatch.setattr(evaluate.shared, "folder", lambda spark: f"file://{tmp_path}")
    q = spark.createDataFrame([(1, "a few words in"), (2, "words here")], "query_id long, text string")
    texts = [(k, f"text {k} has a few words in it" if k % 3 else "no words here or anywhere") for k in range(30)]
    want = [(x, i) for x, t in ((1, "a few words in"), (2, "words here")) for i, s in texts if t in s]
    for most in (1_000_000, 0):
        monkeypatch.setattr(evaluate, "SENT", most, raising=False)
        found = evaluate.holders(q, spark.createDataFrame(texts, "id long, text string"))
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().analyzed().toString()
        assert ("strategy=broadcast" in plan) == (most > 0)
