"""Rows of a table in ascending order of a whole-number key, with each row's successor at hand.

The key range is cut at quantiles; a row goes to the part of its key by its
number (repartitionById), and the least rows of a part also go to the part
before (of the first: to the last), so each part can see what follows its end.
Nothing is ever gathered in one task, and the driver holds one number per part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, key_bounds, parts_for


def parts(df: DataFrame, key: str, n: int | None = None) -> tuple[DataFrame, int]:
    """df with column `part` and their number."""
    n = n or parts_for(df.sparkSession)
    bounds = key_bounds(df, key, n)
    return df.withColumn("part", bucket_of(F.col(key), bounds).cast("int")), len(bounds) + 1


def sorted_parts(df: DataFrame, key: str, *ties: str, n: int | None = None) -> DataFrame:
    """Each partition holds one part, sorted; the parts ascend."""
    cut, n = parts(df, key, n)
    return cut.repartitionById(n, F.col("part")).sortWithinPartitions("part", key, *ties)


def with_tails(df: DataFrame, key: str, *ties: str, n: int | None = None) -> DataFrame:
    """sorted_parts, with rows marked `tail` at each partition's end: the first of them is what follows it."""
    cut, n = parts(df, key, n)
    least = {r["part"]: r["least"] for r in cut.groupBy("part").agg(F.min(key).alias("least")).collect()}  # at most n rows
    if not least:
        return cut.withColumn("tail", F.lit(False))
    has_null = bool(df.filter(F.col(key).isNull()).limit(1).count())
    filled = sorted(least)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}  # of the first: the last
    first_null = has_null and 0 in least
    at = [(p, before[p], None if p == 0 and first_null else least[p]) for p in filled]
    edge = cut.sparkSession.createDataFrame(at, "part int, to int, least bigint")
    edge = F.broadcast(edge)  # a row per part
    tails = cut.join(edge.withColumnRenamed("part", "e_part"), (F.col("part") == F.col("e_part")) & F.col(key).eqNullSafe(F.col("least")))
    both = cut.withColumn("tail", F.lit(False)).unionByName(tails.withColumn("part", F.col("to")).withColumn("tail", F.lit(True)).select(*cut.columns, "tail"))
    return both.repartitionById(n, F.col("part")).sortWithinPartitions("part", "tail", key, *ties)
