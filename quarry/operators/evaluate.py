"""Offline ranking evaluation: metrics, gates, patterns, folds, tuning, learning."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import shared

#: As many pairs of a query and a document are sent to all tasks at most.
SENT = 1_000_000


def per_case(tops: DataFrame, gold: DataFrame, k: int = 5) -> DataFrame:
    """A17.  tops: query_id, id, rank; gold: query_id, gold.  gold_rank (null: missed), rr, ndcg, hit1, hit3, hit5, dup."""
    t = tops.filter(F.col("rank") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("t"))
    j = gold.join(t, "query_id", "left").withColumn("ids", F.transform(F.coalesce("t", F.array().cast(t.schema["t"].dataType)), lambda x: x["id"]))
    at = F.nullif(F.array_position("ids", F.col("gold")), F.lit(0).cast("bigint"))
    j = j.withColumn("gold_rank", at)
    hit = lambda n: F.coalesce(F.col("gold_rank") <= n, F.lit(False))
    return j.select(
        "query_id", "gold_rank", F.coalesce(1 / F.col("gold_rank"), F.lit(0.0)).alias("rr"), F.coalesce(1 / F.log2(F.col("gold_rank") + 1), F.lit(0.0)).alias("ndcg"),
        hit(1).alias("hit1"), hit(3).alias("hit3"), hit(5).alias("hit5"), (F.size("ids") - F.size(F.array_distinct("ids"))).cast("bigint").alias("dup"),
    )


def holders(queries: DataFrame, corpus: DataFrame, held: Callable[[DataFrame], DataFrame] | None = None, frequencies: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, id: every document that holds a query's text as a whole.  queries: query_id, text; corpus: id, text; held and frequencies: where there is an
    index, what it gives for tokens (token): token, id, and token, df.  With frequencies only the rarest tokens' documents are read.

    A query's inner tokens (without its first and last run, which the document may go on) are tokens of each holder, so only documents
    with the rarest of them are searched; a query without inner tokens is looked for in all."""
    inner = text.tokens(F.regexp_replace(F.lower("text"), "^[a-z0-9]+|[a-z0-9]+$", " "))
    t = queries.select("query_id", F.explode(F.array_distinct(inner)).alias("token"))
    asked = t.select("token").distinct()
    p = held(asked) if held and not frequencies else None if frequencies else corpus.select("id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("token")).join(asked, "token", "left_semi")
    df = frequencies(asked) if frequencies else p.groupBy("token").agg(F.count("*").alias("df"))
    rarest = t.join(df, "token", "left").groupBy("query_id").agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)), "token")).alias("token"))
    if frequencies:
        rarest = shared.written(rarest, "rarest")
        p = held(rarest.select("token"))
    # pairs are written for their number: texts are moved only where pairs are too many to be sent to them
    asks, texts = queries.select("query_id", F.col("text").alias("q")), corpus.select("id", "text")
    pairs = shared.written(rarest.join(p, "token").select("query_id", "id"), "pairs")
    found = texts.join(F.broadcast(pairs) if pairs.count() <= SENT else pairs, "id").join(asks, "query_id")
    bare = queries.filter(F.size(inner) == 0).select("query_id", F.col("text").alias("q"))
    if not bare.isEmpty():
        found = found.select("query_id", "id", "q", "text").unionAll(bare.crossJoin(texts).select("query_id", "id", "q", "text"))
    return found.filter(F.contains("text", F.col("q"))).select("query_id", "id").distinct()


def completion_proxy(cases: DataFrame, tops: DataFrame, corpus: DataFrame, k: int = 5) -> DataFrame:
    """By system and case how far its first k texts would help to write the next line.

    cases: query_id, prompt, next_line, identifier, gold; tops: system, query_id, id, rank (a row of rank null for a case
    without hits); corpus: id, text.  gold_rank, rr, hit1, hit3, hit5; coverage: of the next line's tokens that the prompt lacks the share that
    the texts hold; identifier_hit: whether one of them holds the identifier."""
    c = cases.withColumn("new", F.array_except(F.array_distinct(text.tokens(F.col("next_line"))), text.tokens(F.col("prompt"))))
    every = tops.select("system", "query_id").distinct()
    t = tops.filter(F.col("rank") <= k).join(corpus.select("id", "text"), "id").join(c.select("query_id", "new", "identifier"), "query_id")
    held = F.array_intersect("new", text.tokens(F.col("text")))
    g = t.groupBy("system", "query_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(held)))).alias("held"), F.max((F.coalesce("identifier", F.lit("")) != "") & F.contains("text", F.col("identifier"))).alias("identifier_hit")
    )
    first = tops.filter(F.col("rank") <= k).join(cases.select("query_id", "gold"), "query_id").filter(F.col("id") == F.col("gold")).groupBy("system", "query_id").agg(F.min("rank").alias("gold_rank"))
    j = every.join(c.select("query_id", F.size("new").alias("n_new")), "query_id").join(g, ["system", "query_id"], "left").join(first, ["system", "query_id"], "left")
    hit = lambda n: F.coalesce(F.col("gold_rank") <= n, F.lit(False))
    coverage = F.when(F.col("n_new") > 0, F.coalesce("held", F.lit(0)) / F.col("n_new")).otherwise(0.0)
    return j.select("system", "query_id", "gold_rank", F.coalesce(1 / F.col("gold_rank"), F.lit(0.0)).alias("rr"), hit(1).alias("hit1"), hit(3).alias("hit3"), hit(5).alias("hit5"), coverage.alias("coverage"), F.coalesce("identifier_hit", F.lit(False)).alias("identifier_hit"))


METRICS = {"acc1": "hit1", "acc3": "hit3", "acc5": "hit5"}


def summary(cases: DataFrame, *by: str) -> DataFrame:
    """Means over cases: acc1, acc3, acc5, mrr, ndcg, dup, samples."""
    parts = [F.avg(F.col(c).cast("double")).alias(m) for m, c in METRICS.items()]
    return cases.groupBy(*by).agg(*parts, F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"), F.sum("dup").alias("dup"), F.count("*").alias("samples"))


def macro_and_weighted(runs: DataFrame, metrics: Iterable[str]) -> DataFrame:
    """Plain mean over runs, and weighted by samples."""
    rows = [runs.agg(F.lit(m).alias("metric"), F.avg(m).alias("macro"), (F.sum(F.col(m) * F.col("samples")) / F.sum("samples")).alias("weighted")) for m in metrics]
    return reduce(DataFrame.unionAll, rows)


def patterns(cases: DataFrame) -> DataFrame:
    """How often each pattern of hits occurs."""
    one = lambda c: F.when(F.col(c), "1").otherwise("0")
    return cases.groupBy(F.concat(one("hit1"), one("hit3"), one("hit5")).alias("pattern")).agg(F.count("*").alias("n"))


def gold_ranks(listed: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, at: where the list (query_id, id, rank) has the gold; null where it doesn't."""
    found = listed.join(gold, "query_id").filter(F.col("id") == F.col("gold")).groupBy("query_id").agg(F.min("rank").alias("at"))
    return gold.select("query_id").join(found, "query_id", "left")


def recall_ceilings(listed: DataFrame, cases: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Kind, n: how often a longer list has the gold, within each cut, and the same of cases (query_id, hit5) that missed it."""
    j = gold_ranks(listed, gold).join(cases.select("query_id", "hit5"), "query_id")
    within = [("gold_listed", F.col("at").isNotNull()), *((f"gold_listed@{c}", F.col("at") <= c) for c in cuts), ("gold_not_listed", F.col("at").isNull())]
    missed = [(f"missed_{k}", c & ~F.col("hit5")) for k, c in within]
    g = j.agg(*[F.count_if(c).alias(k) for k, c in within + missed])
    return g.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"`{k}`").alias("n")) for k, _ in within + missed])).alias("x")).select("x.*")


def miss_ranks(listed: DataFrame, cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Of missed cases whose gold is in the longer list: cases, mean, least, median (the upper one) and greatest rank of it."""
    w = Window.orderBy("at")
    r = gold_ranks(listed, gold).join(cases.filter(~F.col("hit5")).select("query_id"), "query_id").filter("at is not null")
    by_rank = r.groupBy("at").agg(F.count("*").alias("n"))  # as many rows as the list has places
    run = by_rank.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    half = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("at"))).alias("median")
    return run.agg(F.sum("n").alias("cases"), (F.sum(F.col("at") * F.col("n")) / F.sum("n")).alias("mean"), F.min("at").alias("least"), half, F.max("at").alias("greatest"))


def opportunities(ours: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Pattern, n: which systems hit (by their cases' hit5) how often; `none` where none does."""
    j = ours.select("query_id", F.when(F.col("hit5"), "ours").alias("s0"))
    for k, (name, cases) in enumerate(others.items(), 1):
        j = j.join(cases.select("query_id", F.when(F.col("hit5"), name).alias(f"s{k}")), "query_id")
    who = F.concat_ws(", ", *[f"s{k}" for k in range(len(others) + 1)])
    return j.groupBy(F.when(who == "", "none").otherwise(who).alias("pattern")).agg(F.count("*").alias("n"))


def feature_deltas(candidates: DataFrame, cases: DataFrame, gold: DataFrame, features: list[str]) -> DataFrame:
    """Feature, delta: over missed cases the mean of the gold's feature less the first candidate's.  candidates: query_id, id, rank, features."""
    missed = cases.filter(~F.col("hit5")).select("query_id")
    g = candidates.join(gold, "query_id").filter(F.col("id") == F.col("gold")).select("query_id", *[F.col(f).alias(f"g_{f}") for f in features])
    top = candidates.filter("rank = 1").select("query_id", *features)
    d = g.join(top, "query_id").join(missed, "query_id").agg(*[F.avg(F.col(f"g_{f}") - F.col(f)).alias(f) for f in features])
    return d.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("delta")) for f in features])).alias("x")).select("x.*").filter("delta is not null")


def metric_deltas(after: DataFrame, before: DataFrame) -> DataFrame:
    """H19.  Both: metric, value.  metric, delta."""
    return after.join(before.select("metric", F.col("value").alias("was")), "metric").select("metric", (F.col("value") - F.col("was")).alias("delta"))


def gates(metrics: DataFrame, limits: list[tuple[str, str, float]], baseline: DataFrame | None = None) -> DataFrame:
    """V04.  metrics (and baseline): metric, value.  limits: (metric, kind, bound), kind min, max or delta (over the baseline)."""
    g = metrics.sparkSession.createDataFrame(limits, "metric string, kind string, bound double")
    j = g.join(metrics, "metric", "left")
    base = baseline.select("metric", F.col("value").alias("base")) if baseline is not None else metrics.select("metric", F.lit(None).cast("double").alias("base"))
    j = j.join(base, "metric", "left")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("bound")).when(F.col("kind") == "max", F.col("value") <= F.col("bound")).otherwise(F.col("value") - F.col("base") >= F.col("bound"))
    return j.select("metric", "kind", "bound", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token lists as multisets."""
    names = F.array_distinct(a)
    times = lambda l, t: F.size(F.filter(l, lambda x: x == t))
    shared = F.aggregate(F.transform(names, lambda t: F.least(times(a, t), times(b, t))), F.lit(0), lambda s, x: s + x)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(2 * shared / (F.size(a) + F.size(b)))


def fold(index: Column, folds: int) -> Column:
    """V08."""
    return F.pmod(index * 9973, F.lit(folds))


def rerank(candidates: DataFrame, features: list[str], trials: list[dict[str, float]], k: int = 5) -> DataFrame:
    """V06, V07.  candidates: query_id, id, features.  trial, query_id, id, rank: the first k by each trial's weighted sum.

    Trials are few (a grid's step), so they are columns of one pass rather than passes of their own."""
    score = F.array(*[reduce(lambda s, f, w=w: s + F.col(f) * float(w.get(f, 0.0)), features, F.lit(0.0)) for w in trials])
    rows = candidates.select("query_id", "id", F.posexplode(score).alias("trial", "score"))
    w = Window.partitionBy("trial", "query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("trial", "query_id", "id", "rank")


def trial_metrics(candidates: DataFrame, gold: DataFrame, features: list[str], trials: list[dict[str, float]]) -> list[dict]:
    """One row of metrics by trial, on the driver."""
    tops = rerank(candidates, features, trials)
    hit = tops.join(gold, "query_id").filter(F.col("id") == F.col("gold")).groupBy("trial").agg(F.sum(1 / F.col("rank")).alias("rr"), F.sum((F.col("rank") == 1).cast("int")).alias("h1"), F.count("*").alias("h5"))
    n = max(gold.count(), 1)
    found = {r["trial"]: r for r in hit.collect()}
    return [{"mrr": float(found[t]["rr"]) / n, "acc1": found[t]["h1"] / n, "acc5": found[t]["h5"] / n} if t in found else {"mrr": 0.0, "acc1": 0.0, "acc5": 0.0} for t in range(len(trials))]


def tune(candidates: DataFrame, gold: DataFrame, features: list[str], start: dict[str, float], grid: list[float], passes: int = 1, metric: str = "mrr", guardrails: Iterable[str] = ("acc5",)) -> tuple[dict[str, float], dict]:
    """Coordinate by coordinate; a step counts if the metric grows and no guardrail falls."""
    weights, best = dict(start), trial_metrics(candidates, gold, features, [start])[0]
    for _ in range(passes):
        moved = False
        for f in features:
            trials = [weights | {f: g} for g in grid if g != weights.get(f)]
            for t, m in zip(trials, trial_metrics(candidates, gold, features, trials)):
                if m[metric] > best[metric] and all(m[g] >= best[g] for g in guardrails):
                    weights, best, moved = t, m, True
        if not moved:
            break
    return weights, best


def perceptron(records: Iterable[tuple[np.ndarray, int]], width: int, epochs: int = 5, rate: float = 0.1, margin: float = 0.1, decay: float = 1e-3, bound: float = 5.0) -> np.ndarray:
    """Pairwise, with margin, decay and clamping.  records: (candidate features, gold row)."""
    w = np.zeros(width)
    records = list(records)
    for _ in range(epochs):
        for x, gold in records:
            s = x @ w
            for j in np.flatnonzero(s > s[gold] - margin):
                if j != gold:
                    w = np.clip(w * (1 - decay) + rate * (x[gold] - x[j]), -bound, bound)
    return w


def promote(rows: DataFrame, score: Column, least: float, k: int = 5) -> DataFrame:
    """The best row below place k by `score`, if that is at least `least`, takes place k.  rows: query_id, id, rank."""
    w = Window.partitionBy("query_id")
    r = rows.withColumn("_s", F.when(F.col("rank") > k, score))
    r = r.withColumn("_pick", F.max_by("id", F.when(F.col("_s") >= least, F.struct("_s", -F.col("rank")))).over(w))
    key = F.when(F.col("id") == F.col("_pick"), k).when((F.col("rank") >= k) & F.col("_pick").isNotNull(), F.col("rank") + 1).otherwise(F.col("rank"))
    out = r.withColumn("rank", key).drop("_s", "_pick")
    return out.withColumn("rank", F.row_number().over(w.orderBy("rank", "id")))


def movements(before: DataFrame, after: DataFrame) -> DataFrame:
    """Recovered, lost, improved, worsened, same.  Both: query_id, gold_rank."""
    b, a = F.col("b_rank"), F.col("a_rank")
    j = before.select("query_id", F.col("gold_rank").alias("b_rank")).join(after.select("query_id", F.col("gold_rank").alias("a_rank")), "query_id")
    kind = F.when(b.isNull() & a.isNotNull(), "recovered").when(b.isNotNull() & a.isNull(), "lost").when(a < b, "improved").when(a > b, "worsened").otherwise("same")
    return j.groupBy(kind.alias("movement")).agg(F.count("*").alias("n"))


def verdict(primary: float, guards: Iterable[float], floor: Callable[[float], bool] = lambda d: d >= 0) -> str:
    """Pass, neutral or hold, from deltas."""
    if not all(map(floor, guards)):
        return "hold"
    return "pass" if primary > 0 else "neutral" if primary == 0 else "hold"
