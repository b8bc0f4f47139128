import random

import numpy as np
import pyarrow as pa

from quarry.llm import op2_quality as Q

WORDS = "the river runs past old stone houses while people carry bread and water home before evening falls over quiet green hills".split()


def good(r):
    return " ".join(r.choice(WORDS) for _ in range(60)).capitalize() + "."


def bad(r):
    return " ".join(r.choice(WORDS) + r.choice(["***", "%%%", "$$$"]) for _ in range(60))


def corpus(n=400):
    r = random.Random(2)
    return [(i, good(r) if i % 4 else bad(r), "en" if i % 3 else "de", f"s{i % 5}", int(i % 4 > 0)) for i in range(n)]


def frames(spark):
    rows = corpus()
    docs = spark.createDataFrame([x[:4] for x in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(x[0], x[4], 0) for x in rows if x[0] % 2], "doc_id long, quality int, toxic int").union(spark.createDataFrame([(i, 0, 0) for i in range(0, 200, 8)], "doc_id long, quality int, toxic int"))
    return rows, docs, labels


def test_held_out_accuracy(spark):
    rows, docs, labels = frames(spark)
    got = {r.doc_id: r.keep for r in Q.judgements(docs, labels).collect()}
    held = [x for x in rows if x[0] >= 200 and x[0] % 2 == 0]
    assert np.mean([got[x[0]] == bool(x[4]) for x in held]) > 0.98


def test_rates_by_brute_force(spark):
    """With a fitted model's own odds, site rates and scores follow from the formula."""
    rows, docs, labels = frames(spark)
    model = Q.fit(docs, labels)
    out = Q.judgements(docs, labels).collect()
    known = {r.l_id: r.good for r in Q._labels(labels).collect()}
    x, _ = Q.features(pa.array([r[1] for r in rows]))
    p = 1 / (1 + np.exp(-model.log_odds(x)))
    e = [known.get(r[0], p[i]) for i, r in enumerate(rows)]
    rate = (sum(e) + model.prior) / (len(e) + 1)
    host = {s: [i for i, r in enumerate(rows) if r[3] == s] for s in {r[3] for r in rows}}
    m = {f"s{k}": sum(e[i] for i in host[f"s{k}"]) for k in range(5)}
    spread = sum(len(host[s]) * (m[s] / len(host[s]) - rate) ** 2 for s in host)
    noise = len(host) * rate * (1 - rate)
    between = max((spread - noise) / len(e), 0)
    strength = min(max(rate * (1 - rate) / between - 1, 1), 1e4) if between else 1e4
    path = {}
    for i, r in enumerate(rows):
        path.setdefault((r[3], r[2]), []).append(i)
    above = {k: (m[k[0]] + strength * rate) / (len(host[k[0]]) + strength) for k in path}
    hit = {k: sum(e[i] for i in path[k]) for k in path}
    apart = sum(len(path[k]) * (hit[k] / len(path[k]) - above[k]) ** 2 for k in path) - sum(above[k] * (1 - above[k]) for k in path)
    within = sum(len(path[k]) * above[k] * (1 - above[k]) for k in path) / len(e)
    path_strength = min(max(within / (apart / len(e)) - 1, 1), 1e4) if apart > 0 else 1e4
    for r in out:
        i = r.doc_id
        s = rows[i][3]
        want = (max(m[s] - e[i], 0) + strength * rate) / (len(host[s]) - 1 + strength)
        assert abs(r.host_rate - want) < 1e-6
        one = path[s, r.lang]
        own_path = (max(sum(e[j] for j in one) - e[i], 0) + path_strength * want) / (len(one) - 1 + path_strength)
        assert abs(r.path_rate - own_path) < 1e-6
        odds = model.log_odds(x[i : i + 1])[0] - np.log(model.prior / (1 - model.prior)) + np.log(r.path_rate / (1 - r.path_rate))
        assert abs(r.score - 1 / (1 + np.exp(-odds))) < 1e-6


def test_cases(spark, docs):
    d = docs([(1, None), (2, ""), (3, "   "), (None, "a b"), (4, "x" * 200_000), (4, "x" * 200_000)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.judgements(d, none).collect()
    assert len(out) == 6 and all(r.keep for r in out)
    labels = spark.createDataFrame([(4, 1, 0), (1, 0, 0), (2, None, 0), (None, 0, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert Q.judgements(d, labels).count() == 6
    assert Q.judgements(docs([]), labels).count() == 0
    rows, many, known = frames(spark)
    kept = Q.judgements(many.unionByName(docs([(1000, None)], False).select("doc_id", "text", "lang", "source")), known).filter("doc_id = 1000").head()
    assert kept.doc_odds is None and 0 < kept.score < 1


def test_stage_keeps_what_judgements_keep(spark, tmp_path):
    """Labels against the text's evidence decide near the threshold; rows that share a doc_id, and repeated ones, are each judged."""
    rows, docs, _ = frames(spark)
    docs = docs.unionByName(docs.filter("doc_id < 40")).unionByName(docs.filter("doc_id between 40 and 60").withColumn("doc_id", docs.doc_id + 1))
    labels = spark.createDataFrame([(i, int((i % 4 > 0) != (i % 7 == 0)), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    judged = Q.judgements(docs, labels)
    known = Q.Evidence(docs, labels)
    plain = known.judge(known.rows, known.chance()).filter("keep").count()
    want = sorted((r.doc_id, bytes(r.digest)) for r in judged.filter("keep").collect())
    got = sorted((r.doc_id, bytes(r.digest)) for r in Q.stage(spark, docs, str(tmp_path)).withColumn("digest", Q._digest()).collect())
    assert got == want
    assert plain != len(want) or judged.filter("not keep").count() > 0
    assert "Exchange hashpartitioning(doc_id" not in Q.stage(spark, docs, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_stage_leaves_own_columns(spark, docs, tmp_path):
    rows, many, known = frames(spark)
    known.write.parquet(f"{tmp_path}/labels.parquet")
    d = many.selectExpr("*", "doc_id keep", "'mine' score", "1 l_id", "2 own_id", "3 site_n")
    out = Q.stage(spark, d, str(tmp_path))
    assert out.columns == d.columns
    assert all(r.keep == r.doc_id and r.score == "mine" and r.l_id == 1 for r in out.collect())


def test_sparse_sites_shrink(spark):
    ev = spark.createDataFrame([("big", "p", 0.9)] * 300 + [("big2", "p", 0.1)] * 300 + [("tiny", "p", 0.0)], "host string, path string, e double")
    s = Q.sites(ev, 0.5)
    rows = {r.site_host: r for r in s.table.collect()}
    rate = lambda r: (r.site_hk + s.host_strength * s.rate) / (r.site_hn + s.host_strength)
    assert rate(rows["big"]) > 0.85 and rate(rows["tiny"]) > 0.2
