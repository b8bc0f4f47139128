"""A table of runs that can be taken up again: a row a case, written case by case, and summaries from the table alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared


class RunTable:
    """home/run=NAME/slice=K: the cases of a run whose key falls into slice K, and whether each is done.

    A slice is written as a whole, over what it held, so a run that stops leaves whole slices; taken up again, it works out only those that lack or hold
    failed cases, and of these only the failed ones.

    Cases: a case without a result is failed; a case that is asked for no longer stays in the table but not in summary(); a case's
    key may be null, once."""

    def __init__(self, spark: SparkSession, home: str, key: str, schema: str, slices: int = 16):
        self.spark, self.home, self.key, self.schema, self.slices = spark, home.rstrip("/"), key, f"{schema}, failed string", slices

    def _slice(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.slices)).cast("int")

    def _path(self, run: str, k: int) -> str:
        return f"{self.home}/run={run}/slice={k}"

    def table(self, run: str) -> DataFrame:
        """What is there of a run."""
        there = [n for n in shared.names(self.spark, f"{self.home}/run={run}") if n.startswith("slice=") and "_SUCCESS" in shared.names(self.spark, f"{self.home}/run={run}/{n}")]
        if not there:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.home}/run={run}/{n}" for n in there])

    def left(self, run: str, cases: DataFrame) -> DataFrame:
        """The cases that have no result yet, or a failed one."""
        done = self.table(run).filter("failed is null").select(F.col(self.key).alias("d_key"))
        return cases.join(done, cases[self.key].eqNullSafe(done["d_key"]), "left_anti")

    def go(self, run: str, cases: DataFrame, work: Callable[[DataFrame], DataFrame]) -> int:
        """work(cases that are left of a slice) gives their results, with `failed` (null, or why); how many slices were worked on.

        What work leaves out is failed, too.  A slice's failure as a whole goes up to the caller; slices before it are kept."""
        wanted = shared.written(self.left(run, cases).withColumn("slice", self._slice()), "cases")
        todo = sorted(r[0] for r in wanted.select("slice").distinct().collect())  # at most all slices
        names = [c.split()[0] for c in self.schema.split(", ")]
        for k in todo:
            mine = wanted.filter(F.col("slice") == k).drop("slice")
            got = work(mine).select(*names)
            keys, asked = got.select(F.col(self.key).alias("g_key")), mine.select(F.col(self.key).alias("a_key"))
            silent = asked.join(keys, asked["a_key"].eqNullSafe(keys["g_key"]), "left_anti").withColumnRenamed("a_key", self.key).withColumn("failed", F.lit("no result"))
            fresh = shared.written(got.unionByName(silent, allowMissingColumns=True).select(*names), "results")
            old = self.table(run).filter(self._slice() == k)
            own = fresh.select(F.col(self.key).alias("f_key"))
            both = old.join(own, old[self.key].eqNullSafe(own["f_key"]), "left_anti").unionByName(fresh)
            shared.written(both, "slice").write.mode("overwrite").parquet(self._path(run, k))
        return len(todo)

    def summary(self, run: str, cases: DataFrame, metrics: list[str]) -> DataFrame:
        """run, cases, done, failed, and the mean of each metric over the done ones, from the table."""
        rows = self.table(run).withColumnRenamed(self.key, "t_key")
        j = cases.select(F.col(self.key).alias("c_key")).join(rows, F.col("c_key").eqNullSafe(F.col("t_key")), "left")
        done = F.col("failed").isNull() & F.col(metrics[0]).isNotNull()
        return j.agg(F.lit(run).alias("run"), F.count("*").alias("cases"), F.count_if(done).alias("done"), F.count_if(F.col("failed").isNotNull()).alias("failed"), *[F.avg(F.when(done, F.col(m).cast("double"))).alias(m) for m in metrics])
