import hashlib
import os
import re

import pytest

import corpus_pipeline as P
from quarry.llm import op2_quality, op3_bpe, op4_decontam, op6_secrets, op9_neardup
from quarry.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def test_stages_by_brute_force(spark):
    """Each stage's decisions worked out from its own operator or by brute force, on one pass over the small table."""
    import public_tokenizers
    import tiktoken

    from .test_op4_decontam import ws
    from .test_op6_secrets import brute as secrets
    from .test_op9_neardup import brute as near

    docs = [r.asDict() for r in table(spark, SF, "documents").collect()]
    keep = {r.doc_id for r in op2_quality.judgements(table(spark, SF, "documents"), table(spark, SF, "labels")).filter("keep").collect()}
    docs = [d for d in docs if d["doc_id"] in keep]
    first = {c[0] for c in near([(d["doc_id"], d["text"]) for d in docs], 5) if c[3]}
    docs = [d for d in docs if d["doc_id"] in first]
    grams = set()
    for r in table(spark, SF, "benchmark").collect():
        w = ws(r.text)
        n = min(len(w), 10)
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(g) for g in grams}
    dirty = lambda w: any(tuple(w[k : k + n]) in grams for n in sizes for k in range(len(w) - n + 1))
    docs = [d for d in docs if not dirty(ws(d["text"]))]
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op3_bpe.load_ranks(public_tokenizers.path(op3_bpe.RANKS)), special_tokens={})
    want = []
    for d in docs:
        at, out = 0, ""
        for a, _, b in secrets(d["text"])[1]:
            if a >= at:
                out += d["text"][at:a] + op6_secrets.MASK
            at = max(at, b)
        t = out + d["text"][at:]
        ids = one.encode_ordinary(t)
        want.append((d["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = P.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_stages(spark):
    assert [f for _, f in P.STAGES] == [op2_quality.stage, op9_neardup.stage, op4_decontam.stage, op6_secrets.stage, op3_bpe.stage]
    docs = table(spark, SF, "documents")
    for _, f in P.STAGES[:-1]:
        assert f(spark, docs, SF).columns == docs.columns
        assert f(spark, docs.limit(0), SF).count() == 0


def test_held_out_quality(spark):
    """Fitted on even labels, judged on odd ones."""
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    got = op2_quality.judgements(table(spark, sf, "documents"), labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id")
    n, right, good_lost = got.selectExpr("count(*)", "sum(int(keep = (quality = 1)))", "sum(int(quality = 1 and not keep))").head()
    assert right / n > 0.97 and good_lost <= 0.02 * n


def test_native_stage_has_no_python(spark):
    plan = op6_secrets.stage(spark, table(spark, SF, "documents"), SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_cases(spark, docs, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing names, through all stages."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [(1, "river runs past old stone houses while people carry bread"), (2, "river runs past old stone houses while people carry bread"), (None, "river runs past old stone houses while people carry bread"), (None, None), (3, ""), (4, long), (4, long), (5, "x" * 1_000_000), (6, "one passage of the test that nobody may train on by any means"), (7, "password = hunter2222 is here"), (8, "a/" * 1_000_000 + "end")]
    d = docs(rows).withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") != 4, F.col("source"))).withColumn("near_duplicate_id", F.lit("own"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b", "passage of the test that nobody may train on by any"), (None, "never seen at all"), ("c", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([(r.doc_id, r.decoded_sha256) for r in P.run(spark, str(tmp_path)).collect()], key=str)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, sha(rows[0][1])), (None, sha("")), (3, sha("")), (4, sha(long)), (5, sha(rows[7][1])), (7, sha("[SECRET] is here")), (8, sha(rows[-1][1]))]
    assert got == sorted(want, key=str)
    at = d
    for _, f in P.STAGES[:-1]:
        at = f(spark, at, str(tmp_path))
        assert at.columns == d.columns and all(r.near_duplicate_id == "own" and r.score == 7 for r in at.collect())
    empty = tmp_path / "empty"
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert P.run(spark, str(empty)).count() == 0
