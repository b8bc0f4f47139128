"""What misses of an evaluation have in common, runs side by side, and reranking by weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as V
from . import evaluate as E
from . import retrieval as P

_GOLD = E._GOLD


def _parts(spark, sf):
    """(the 50 BM25 candidates, Jaccard's cases, the gold)."""
    index = P.kept(spark, sf)
    gold = E.gold_all(spark, sf, index)
    found = E.tops(spark, sf, {"bm25": P.CANDIDATES, "jaccard": P.K}, index)
    return found["bm25"], V.per_case(found["jaccard"], gold), gold


def recall_ceilings(spark, sf):
    """A19, V05."""
    return V.recall_ceilings(*_parts(spark, sf))


def miss_ranks(spark, sf):
    """A19."""
    m = V.miss_ranks(*_parts(spark, sf))
    return m.select(F.coalesce("cases", F.lit(0)).alias("cases"), F.round("mean", 6).alias("mean"), *[F.col(c).cast("bigint").alias(c) for c in ("least", "median", "greatest")])


def opportunities(spark, sf):
    """BM25 is ours, Jaccard the other."""
    bm25, jaccard = E.judged(spark, sf, "bm25", "jaccard")
    return V.opportunities(bm25, {"jaccard": jaccard})


def feature_deltas(spark, sf):
    """Text size, of the gold less the first candidate's."""
    listed, cases, gold = _parts(spark, sf)
    c = listed.join(P.corpus_of(spark, sf), "id").select("query_id", "id", "rank", F.length("text").cast("double").alias("size"))
    return V.feature_deltas(c, cases, gold, ["size"]).select("feature", F.round("delta", 4).alias("delta"))


def run_matrix(spark, sf):
    """A run for each remainder of the items, by system."""
    bm25, jaccard = E.judged(spark, sf, "bm25", "jaccard")
    both = bm25.withColumn("system", F.lit("bm25")).unionAll(jaccard.withColumn("system", F.lit("jaccard")))
    s = V.summary(both.withColumn("run", F.col("query_id") % 4), "system", "run")
    return s.select("system", "run", *[F.round(m, 6).alias(m) for m in ("acc1", "acc5", "mrr")], "samples")


def metric_deltas(spark, sf):
    """BM25's metrics less Jaccard's."""
    bm25, jaccard = E.judged(spark, sf, "bm25", "jaccard")
    of = lambda cases: V.summary(cases).select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("acc1", "acc5", "mrr", "ndcg")])).alias("x")).select("x.*")
    return V.metric_deltas(of(bm25), of(jaccard)).select("metric", F.round("delta", 6).alias("delta"))


def weighted_rerank(spark, sf):
    """The five best by two sets of weights, over rank and size."""
    c = P.candidates(spark, sf).select("query_id", "id", (1 / F.col("rank")).alias("place"), (F.least(F.length("text"), F.lit(4000)) / 4000).alias("size"))
    r = V.rerank(c, ["place", "size"], [{"place": 1.0}, {"place": 1.0, "size": 0.5}])
    return r.select(F.col("trial").cast("bigint").alias("trial"), "query_id", F.col("id").alias("doc_id"), F.col("rank").cast("bigint").alias("rank"))


QUERIES = {f.__name__: f for f in (recall_ceilings, miss_ranks, opportunities, feature_deltas, run_matrix, metric_deltas, weighted_rerank)}

_AT = f"{_GOLD}, ga as materialized (select go.query_id, bk.rank r, coalesce(cj.gr, 99) > 5 missed from go join cj using (query_id) left join bk on bk.query_id = go.query_id and bk.id = gold and bk.rank <= 50)"
_KINDS = [("gold_listed", "r is not null"), *((f"gold_listed@{c}", f"r <= {c}") for c in (5, 10, 20)), ("gold_not_listed", "r is null")]
_MEANS = "avg((coalesce(gr, 99) <= 1)::int) acc1, avg((coalesce(gr, 99) <= 5)::int) acc5, avg(coalesce(1 / gr, 0)) mrr, avg(coalesce(1 / log2(gr + 1), 0)) ndcg, count(*) samples"
SQL = {
    "recall_ceilings": f"with {_AT} " + " union all ".join([f"select '{k}' kind, count(*) filter ({c}) n from ga" for k, c in _KINDS] + [f"select 'missed_{k}', count(*) filter (({c}) and missed) from ga" for k, c in _KINDS]),
    "miss_ranks": f"with {_AT}, m as (select r, row_number() over (order by r) i, count(*) over () n from ga where missed and r is not null) select count(*) as cases, round(avg(r), 6) mean, min(r) least, max(case when i = n // 2 + 1 then r end) median, max(r) greatest from m",
    "opportunities": f"with {_GOLD}, x as (select coalesce(cb.gr, 99) <= 5 a, coalesce(cj.gr, 99) <= 5 b from cb join cj using (query_id)) select case when a and b then 'ours, jaccard' when a then 'ours' when b then 'jaccard' else 'none' end pattern, count(*) n from x group by 1",
    "feature_deltas": f"with {_AT}, t as (select c.query_id, length(c.text) z from c where rank = 1), x as (select length(c.text) - z d from ga join go using (query_id) join c on c.query_id = ga.query_id and c.id = gold join t on t.query_id = ga.query_id where missed and r is not null) select 'size' feature, round(avg(d), 4) delta from x having count(*) > 0",
    "run_matrix": f"with {_GOLD}, x as (select 'bm25' as system, query_id, gr from cb union all select 'jaccard', query_id, gr from cj), s as (select system, query_id % 4 run, {_MEANS} from x group by 1, 2) select system, run, round(acc1, 6) acc1, round(acc5, 6) acc5, round(mrr, 6) mrr, samples from s",
    "metric_deltas": f"with {_GOLD}, a as (select {_MEANS} from cb), b as (select {_MEANS} from cj) " + " union all ".join(f"select '{m}' metric, round(a.{m} - b.{m}, 6) delta from a, b" for m in ("acc1", "acc5", "mrr", "ndcg")),
    "weighted_rerank": f"""with {P._CAND}, x as (select query_id, id, 1.0::double / rank p, least(length(text), 4000)::double / 4000 z from c),
u as (select 0 trial, query_id, id, p s from x union all select 1, query_id, id, p + z * 0.5::double from x)
select trial, query_id, id doc_id, row_number() over (partition by trial, query_id order by s desc, id) rank from u qualify rank <= 5""",
}
