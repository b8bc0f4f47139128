"""Plans, gates and candidate rules on small inputs."""

from pyspark.sql import functions as F

from quarry.functions import code
from quarry.operators import candidates as C


def one(spark, column, t):
    return spark.createDataFrame([(t,)], "t string").select(column.alias("x")).head().x


def test_plan_of_code_and_prose(spark):
    p = one(spark, code.plan(F.col("t")), "async def checkout(cart):\n    gateway = resolve_payment_gateway(cart)\n    return self.pay(gateway)")
    assert {"resolve_payment_gateway", "resolve", "payment", "gateway"} <= set(p.ranking)
    assert not {"async", "def", "self", "return"} & set(p.fts)
    p = one(spark, code.plan(F.col("t")), "how to delete active cache records")
    assert {"remove", "evict", "purge", "clear"} & set(p.fts) and len(p.fts) <= 32


def test_gates(spark):
    assert one(spark, code.detected_language(F.col("t")), "sort a list in golang please") == "go"
    assert one(spark, code.detected_language(F.col("t")), "plain words") == ""
    assert one(spark, code.without_language(F.array(F.lit("go"), F.lit("sort")), F.lit("go")), "") == ["sort"]
    assert one(spark, code.without_language(F.array(F.lit("go")), F.lit("go")), "") == ["go"]
    assert one(spark, code.import_lines(F.col("t")), "import a\nfrom b import c\nx") == 2


def test_focus_and_priors(spark):
    f = one(spark, code.focus(F.col("t"), F.lit(10), F.lit(12), 1), "a\nb\nc\nd")
    assert (f.text, f.start_line, f.end_line) == ("b\nc\nd", 11, 13)
    assert [one(spark, code.bracket_prior(F.col("t")), t) for t in ("(a[b])", ")(", "((", "x")] == [0.0, 10.0, 10.0, 0.0]
    assert one(spark, code.shell_quoted(F.col("t")), "it's") == "'it'\\''s'"
    assert one(spark, code.first_completion_line(F.col("t")), "```py\n\n  x = 1\n") == "  x = 1"
    assert one(spark, code.imported_names(F.col("t")), "from a.b import c as d, e") == ["c", "d", "e"]
    assert one(spark, code.imported_names(F.col("t")), "import { x, y as z } from './m'") == ["x", "y", "z"]
    got = one(spark, code.features(F.col("t"), F.lit("def load(x):\n    pass\n")), "y = load(z)")
    assert got.calls == 1.0 and got.declarations > 0


def test_suffix_match(spark):
    m = lambda a, b: one(spark, code.suffix_match(F.lit(a), F.lit(b)), "")
    assert m("a/b/c.py", "b/c.py") and m("c.py", "b/c.py") and not m("xc.py", "c.py")


def test_backfill(spark):
    have = spark.createDataFrame([(1, 5, 1)], "query_id long, id long, ord int")
    corpus = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    assert [r.id for r in C.backfill(have, corpus, 4).orderBy("ord").collect()] == [5, 1, 2, 3]
    assert C.small_corpus(have, corpus, 4).count() == 1 and C.small_corpus(have, corpus, 20).count() == 8
    assert [r.id for r in C.newest(corpus, 2).collect()] == [8, 7]


def test_recency_and_structured(spark):
    c = spark.createDataFrame([(1, 1, "a/b.py", False), (1, 2, "c.py", True), (1, 3, "z.py", False)], "query_id long, id long, path string, primary boolean")
    got = {r.id: r.recency for r in C.recency(c, [("b.py", 0.05), ("x/c.py", 0.02)]).collect()}
    assert got == {1: 0.05, 2: 0.02, 3: 0.0}
    ranks = spark.createDataFrame([(1, "a/b.py", 4), (1, "c.py", 1)], "query_id long, path string, rank int")
    assert {r.id: r.structured for r in C.structured_boost(c, ranks).collect()} == {1: 0.01, 2: 0.0, 3: 0.0}
