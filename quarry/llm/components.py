"""Connected components of an edge table, by least neighbours and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, release, written


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v bigint -> node, root (the least node reached).

    Rounds grow with the logarithm of a component's width.  Each round's table is
    written to the shared folder; the driver sees only how many roots changed."""
    both = both_table = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    state = table = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "roots")
    while True:
        near = both.join(state, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        step = state.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        over = state.select(F.col("node").alias("r_node"), F.col("root").alias("r_root"))
        step = written(step.join(over, F.col("root") == F.col("r_node")).select("node", "was", F.least("root", "r_root").alias("root")), "roots")
        changed = step.filter("root < was").limit(1).count()
        discard(table)
        table, state = step, step.select("node", "root")
        release(edges.sparkSession)
        if not changed:
            discard(both_table)
            return state
