"""Candidate sources beside full-text hits, and small rules over ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .retrieval import top_k


def newest(corpus: DataFrame, limit: int) -> DataFrame:
    """S09."""
    return corpus.orderBy(F.desc("id")).limit(limit)


def backfill(candidates: DataFrame, corpus: DataFrame, cap: int) -> DataFrame:
    """Each query is filled up to `cap` with the oldest ids that it lacks.  The oldest `cap` suffice for that whatever it has: that many more are read."""
    have = candidates.groupBy("query_id").agg(F.count("*").alias("have"), F.max("ord").alias("last"), F.collect_set("id").alias("ids"))  # at most cap ids
    oldest = F.broadcast(corpus.select("id").orderBy("id").limit(2 * cap))  # bounded by cap
    more = have.filter(F.col("have") < cap).join(oldest, ~F.array_contains("ids", F.col("id")))
    more = top_k(more, cap, F.asc("id")).filter(F.col("rank") <= cap - F.col("have"))
    return candidates.select("query_id", "id", "ord").unionAll(more.select("query_id", "id", (F.col("last") + F.col("rank")).cast(candidates.schema["ord"].dataType)))


def small_corpus(candidates: DataFrame, corpus: DataFrame, cap: int) -> DataFrame:
    """Backfill only where the corpus as a whole fits under the cap."""
    return backfill(candidates, corpus, cap) if corpus.limit(cap + 1).count() <= cap else candidates.select("query_id", "id", "ord")


def best_path_ranks(hits: DataFrame) -> DataFrame:
    """W03.  hits: query_id, id, rank, of several query paths: the best rank of each."""
    return hits.groupBy("query_id", "id").agg(F.min("rank").alias("rank"))


def structured_paths(symbols: DataFrame, references: DataFrame, imports: DataFrame, limit: int = 20) -> DataFrame:
    """U09.  All: query_id, path, rank; imports have target_path too.  By query the first `limit` paths: of symbols, of references, of imports the target, then the source; a path counts where it comes first."""
    of = lambda d, no, c, sub: d.select("query_id", F.col(c).alias("path"), F.struct(F.lit(no).alias("source_no"), "rank", F.lit(sub).alias("sub")).alias("at"))
    u = of(symbols, 0, "path", 0).unionAll(of(references, 1, "path", 0)).unionAll(of(imports, 2, "target_path", 0)).unionAll(of(imports, 2, "path", 1))
    once = u.filter("path <> ''").groupBy("query_id", "path").agg(F.min("at").alias("at"))
    return top_k(once, limit, F.asc("at"), F.asc("path")).select("query_id", "path", "rank")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """N rows without replacement, by a hash of seed and key; all where n is nought or there are no more."""
    return df if n <= 0 else df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def merge_snippets(focused: DataFrame, fallback: DataFrame, limit: int) -> DataFrame:
    """U07.  Both: query_id, path, start_line, end_line, rank.  Focused ones first; of one place the first; at most `limit` a query."""
    place = ["query_id", "path", "start_line", "end_line"]
    u = focused.select(*place, F.struct(F.lit(0).alias("source_no"), "rank").alias("at")).unionAll(fallback.select(*place, F.struct(F.lit(1).alias("source_no"), "rank").alias("at")))
    once = u.groupBy(*place).agg(F.min("at").alias("at"))
    return top_k(once, limit, F.asc("at"), F.asc("path"), F.asc("start_line"), F.asc("end_line")).withColumn("focused", F.col("at.source_no") == 0).drop("at")


def chunks_of_paths(paths: DataFrame, knowledge: DataFrame, limit: int) -> DataFrame:
    """Of each path its first chunks, by line."""
    w = Window.partitionBy("path").orderBy("start_line", "id")
    return knowledge.join(paths.select("path").distinct(), "path").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= limit).drop("nth")


def path_languages(knowledge: DataFrame) -> DataFrame:
    """S14, A05."""
    return knowledge.select("path", text.language(F.col("language")).alias("language")).distinct()


def dominant_language(ranked: DataFrame) -> DataFrame:
    """Of each query the language that first reaches the greatest count in rank order."""
    r = ranked.withColumn("language", text.language(F.col("language"))).filter("language <> ''")
    running = F.row_number().over(Window.partitionBy("query_id", "language").orderBy("rank"))
    return r.withColumn("running", running).groupBy("query_id").agg(F.max_by("language", F.struct("running", -F.col("rank"))).alias("language"))


def recency(candidates: DataFrame, recent: list[tuple[str, float]]) -> DataFrame:
    """The greatest weight of a recent file whose path is a tail of the candidate's, or the other way round."""
    from .failure import path_tails

    spark = candidates.sparkSession
    r = spark.createDataFrame(recent or [("", 0.0)], "r_path string, weight double").filter("r_path <> ''")  # at most the 20 that the source gives
    tails = candidates.select("query_id", "id", "path", F.explode(path_tails(F.col("path"))).alias("tail")).join(r.select(F.col("r_path").alias("tail"), "weight"), "tail").select("query_id", "id", "weight")
    longer = r.select("weight", F.explode(path_tails(F.col("r_path"))).alias("path")).join(candidates.select("query_id", "id", "path"), "path").select("query_id", "id", "weight")
    best = tails.unionAll(longer).groupBy("query_id", "id").agg(F.max("weight").alias("recency"))
    return candidates.join(best, ["query_id", "id"], "left").withColumn("recency", F.coalesce("recency", F.lit(0.0)))


def structured_boost(candidates: DataFrame, path_ranks: DataFrame) -> DataFrame:
    """0.02 / sqrt(rank) by the candidate's path, for rows that full text did not find."""
    j = candidates.join(path_ranks.select("query_id", "path", F.col("rank").alias("path_rank")), ["query_id", "path"], "left")
    return j.withColumn("structured", F.when(F.col("path_rank").isNotNull() & ~F.col("primary"), 0.02 / F.sqrt("path_rank")).otherwise(0.0)).drop("path_rank")


def structural_rerank(hits: DataFrame) -> DataFrame:
    """A10.  hits: query_id, path, kind, rank.  The sum of w / (60 + rank) by path, scaled to .06 of the best, and the best rank."""
    kind = F.col("kind")
    w = F.when(kind.isin("class", "type", "interface", "struct"), 1.25).when(kind.isin("function", "method", "constructor"), 1.15).when(kind == "reference", 0.85).when(kind == "import_target", 1.00).when(kind == "importer", 0.70).otherwise(0.95)
    g = hits.groupBy("query_id", "path").agg(F.sum(w / (60 + F.col("rank"))).alias("s"), F.min("rank").alias("best_rank"))
    return g.withColumn("boost", 0.06 * F.col("s") / F.max("s").over(Window.partitionBy("query_id"))).drop("s")


def profile(rows: DataFrame, weights: dict[str, float], window: int = 20) -> DataFrame:
    """Within the first `window` places rows are ordered anew by a weighted sum of scaled features; ties keep their place."""
    from .retrieval import minmax

    head = F.col("rank") <= window
    scaled = minmax(rows.filter(head), *weights)
    score = sum((F.col(f"{f}_scaled") * w for f, w in weights.items()), F.lit(0.0))
    again = scaled.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), F.asc("rank")))).select("query_id", "id", "place")
    return rows.join(again, ["query_id", "id"], "left").withColumn("rank", F.coalesce("place", "rank")).drop("place")
