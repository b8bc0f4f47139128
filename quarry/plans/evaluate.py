"""Evaluation queries: BM25 and Jaccard against passages that documents hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import retrieval as R
from ..sources import shared
from . import retrieval as P
from .retrieval import read, toks


def gold_all(spark, sf, index=None):
    """The first document, by id, that holds the item's text as a whole; an item whose holders are no candidates is a miss."""
    index = index or P.kept(spark, sf)
    held = V.holders(P.queries_of(spark, sf), P.corpus_of(spark, sf), index.held, index.frequencies)
    return shared.written(held.groupBy("query_id").agg(F.min("id").alias("gold")), "gold")


def tops(spark, sf, keep, index=None):
    """By system (bm25, jaccard) query_id, id, rank of its best, as many as `keep` says, from one pass over the index."""
    found = (index or P.kept(spark, sf)).bests(P.queries_of(spark, sf), keep)
    return {s: shared.written(t.select("query_id", "id", "rank"), "best") for s, t in found.items()}


def judged(spark, sf, *systems, truth=gold_all):
    """The cases of each system; the index is compared with the corpus once, and the truth is looked for once."""
    index = P.kept(spark, sf)
    gold = truth(spark, sf, index)
    found = tops(spark, sf, dict.fromkeys(systems, P.K), index)
    return [V.per_case(found[s], gold) for s in systems]


def cases(spark, sf, system="bm25", truth=gold_all):
    return judged(spark, sf, system, truth=truth)[0]


def eval_cases(spark, sf, truth=gold_all):
    return cases(spark, sf, truth=truth).select("query_id", "gold_rank", F.round("rr", 6).alias("rr"), F.round("ndcg", 6).alias("ndcg"), "hit1", "hit5", "dup")


def eval_metrics(spark, sf, truth=gold_all):
    bm25, jaccard = judged(spark, sf, "bm25", "jaccard", truth=truth)
    both = bm25.withColumn("system", F.lit("bm25")).unionAll(jaccard.withColumn("system", F.lit("jaccard")))
    return V.summary(both, "system").select("system", *[F.round(m, 6).alias(m) for m in ("acc1", "acc3", "acc5", "mrr", "ndcg")], "dup", "samples")


def hit_patterns(spark, sf, truth=gold_all):
    return V.patterns(cases(spark, sf, "jaccard", truth))


def eval_gates(spark, sf, truth=gold_all):
    s = V.summary(cases(spark, sf, truth=truth))
    m = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in ("acc1", "acc5", "mrr")])).alias("x")).select("x.*")
    return V.gates(m, [("acc1", "min", 0.17), ("acc5", "min", 0.59), ("mrr", "max", 0.5)]).select("metric", "kind", "bound", F.round("value", 6).alias("value"), "passed")


def weighted_macro(spark, sf, truth=gold_all):
    """Runs are the benchmark's items by remainder."""
    c = cases(spark, sf, "jaccard", truth).withColumn("run", F.col("query_id") % 3)
    return V.macro_and_weighted(V.summary(c, "run"), ["acc1", "mrr"]).select("metric", F.round("macro", 6).alias("macro"), F.round("weighted", 6).alias("weighted"))


def token_f1(spark, sf):
    from ..functions import text

    q = P.queries_of(spark, sf).select("query_id", F.col("text").alias("q"))
    c = P.candidates(spark, sf).filter("rank = 1").join(q, "query_id")
    return c.select("query_id", F.col("id").alias("doc_id"), F.round(V.token_f1(text.tokens(F.col("q")), text.tokens(F.col("text"))), 6).alias("f1"))


def folds_split(spark, sf):
    l = read(spark, sf, "labels")
    return l.groupBy(V.fold(F.col("doc_id"), 5).alias("fold"), "quality").agg(F.count("*").alias("n"))


def promotion(spark, sf):
    """One Jaccard favourite from below place 5."""
    c, ranks = P.rank_tables(spark, sf)
    rows = c.select("query_id", "id", "rank").join(ranks["jaccard"], ["query_id", "id"], "left")
    return P.shown(V.promote(rows, 1 / F.col("jaccard"), 0.2).filter("rank <= 5"), "rank")


def rank_movements(spark, sf, truth=gold_all):
    return V.movements(*judged(spark, sf, "jaccard", "bm25", truth=truth))


QUERIES = {f.__name__: f for f in (token_f1, folds_split, promotion)}
#: With the ground truth from all documents.
_TRUE = (eval_cases, eval_metrics, hit_patterns, eval_gates, weighted_macro, rank_movements)
QUERIES |= {f"{f.__name__}_all": f for f in _TRUE}

_GOLD = f"""{P._CAND}, {P._JAC},
go as materialized (select query_id, min(id) gold from dt join q on contains(text, q_text) group by query_id),
tb as (select query_id, id, rank from bk where rank <= 5),
tj as (select query_id, id, row_number() over (partition by query_id order by round(score, 9) desc, id) rank from jr qualify rank <= 5),
cb as materialized (select go.query_id, rank gr from go left join tb on tb.query_id = go.query_id and id = gold),
cj as materialized (select go.query_id, rank gr from go left join tj on tj.query_id = go.query_id and id = gold)"""
_SUM = "avg((coalesce(gr, 99) <= 1)::int) acc1, avg((coalesce(gr, 99) <= 3)::int) acc3, avg((coalesce(gr, 99) <= 5)::int) acc5, avg(coalesce(1 / gr, 0)) mrr, avg(coalesce(1 / log2(gr + 1), 0)) ndcg, count(*) samples"

SQL = {
    "eval_cases_all": f"with {_GOLD} select query_id, gr gold_rank, round(coalesce(1 / gr, 0), 6) rr, round(coalesce(1 / log2(gr + 1), 0), 6) ndcg, coalesce(gr, 99) <= 1 hit1, coalesce(gr, 99) <= 5 hit5, 0::bigint dup from cb",
    "eval_metrics_all": f"with {_GOLD} select s as system, round(acc1, 6) acc1, round(acc3, 6) acc3, round(acc5, 6) acc5, round(mrr, 6) mrr, round(ndcg, 6) ndcg, 0::bigint dup, samples from (select 'bm25' s, {_SUM} from cb union all select 'jaccard', {_SUM} from cj)",
    "hit_patterns_all": f"with {_GOLD} select (coalesce(gr, 99) <= 1)::int::varchar || (coalesce(gr, 99) <= 3)::int || (coalesce(gr, 99) <= 5)::int pattern, count(*) n from cj group by 1",
    "eval_gates_all": f"with {_GOLD}, m as (select {_SUM} from cb) select 'acc1' metric, 'min' kind, 0.17::double bound, round(acc1, 6) as value, acc1 >= 0.17 passed from m union all select 'acc5', 'min', 0.59, round(acc5, 6), acc5 >= 0.59 from m union all select 'mrr', 'max', 0.5, round(mrr, 6), mrr <= 0.5 from m",
    "weighted_macro_all": f"with {_GOLD}, r as (select query_id % 3 run, {_SUM} from cj group by 1) select 'acc1' metric, round(avg(acc1), 6) macro, round(sum(acc1 * samples) / sum(samples), 6) weighted from r union all select 'mrr', round(avg(mrr), 6), round(sum(mrr * samples) / sum(samples), 6) from r",
    "token_f1": f"""with {P._CAND}, a as (select query_id, id, {toks('q_text')} x, ts y from c join q using (query_id) where rank = 1),
m as (select query_id, sum(least(n, k)) s from (select query_id, t, count(*) n from (select query_id, unnest(x) t from a) group by query_id, t) join (select query_id, t, count(*) k from (select query_id, unnest(y) t from a) group by query_id, t) using (query_id, t) group by query_id)
select query_id, id doc_id, round(2 * coalesce(s, 0) / (len(x) + len(y)), 6) f1 from a left join m using (query_id)""",
    "folds_split": "select (doc_id * 9973) % 5 fold, quality, count(*) n from labels group by 1, 2",
    "promotion": f"""with {P._RANKS}, a as (select c.query_id, c.id, rank, case when rank > 5 and 1 / r >= 0.2 then 1 / r end s from c left join rj using (query_id, id)),
p as (select query_id, arg_max(id, s * 1000 - rank / 1000.0) p from a where s is not null group by query_id),
k as (select a.query_id, id, case when id = p then 5 when rank >= 5 and p is not null then rank + 1 else rank end key from a left join p using (query_id))
select query_id, id doc_id, rank from (select query_id, id, row_number() over (partition by query_id order by key, id) rank from k) where rank <= 5""",
    "rank_movements_all": f"with {_GOLD} select case when cj.gr is null and cb.gr is not null then 'recovered' when cj.gr is not null and cb.gr is null then 'lost' when cb.gr < cj.gr then 'improved' when cb.gr > cj.gr then 'worsened' else 'same' end movement, count(*) n from cb join cj using (query_id) group by 1",
}
