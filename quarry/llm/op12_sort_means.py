"""Centroid clustering by sort-means, in whole numbers.

In each round the distances between centroids are known, and for each centroid the
others in order of their distance from it.  A vector starts from the centroid it had
and looks at the others in that one's order; it stops at the first that is strictly
further from its old centroid than twice its own distance, as by the triangle
inequality neither that one nor any after it is nearer or as near.  So every vector has
the nearest centroid, of equally near ones that of the smaller number, as if it had
looked at all.

A round is a pass over the vectors, whose table is written with their centroids for
the next, and a grouped sum of few rows; the driver holds k centroids.

Cases: vectors that are null, of another length or with a component that is null or
not finite are left out; repeated rows and repeated ids count each; equal hashes are
ordered by the vector; vec_id null is never a first centroid while others are left, as its
hash is null; fewer than k vectors make as many centroids; an empty table
gives no row; components of 2^20 and more, whose squares may not add up exactly in 64
bits, are an error; further columns are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, table, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
#: Of a component times SCALE; (2 * 2^26)^2 * 64 * 4 still fits a signed 64-bit number.
MOST = 1 << 26


def vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array<int>): the vectors that count, in whole numbers."""
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == dimensions) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = pick(embeddings, "vec_id", "embedding").filter(F.coalesce(whole, F.lit(False)))
    part = lambda c: F.when(F.abs(c) * scale < MOST, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is {MOST} or more")).cast("int"))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, part).alias("v"))


def first_centroids(found: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids have the least hashes, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = found.select(hashed.alias("hash"), "v").orderBy(F.asc_nulls_last("hash"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Neighbours:
    """Centroids, and each one's others by distance."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.apart = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
        self.order = np.argsort(self.apart, axis=1, kind="stable")

    def nearest(self, x: np.ndarray, had: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(centroid, squared distance) of each vector, and how many distances that took; had: each one's centroid so far."""
        best, own = had.copy(), ((x - self.centroids[had]) ** 2).sum(1)
        least, looked = own.copy(), len(x)
        for c in np.unique(had).tolist():
            rows = np.flatnonzero(had == c)
            for j in self.order[c].tolist():
                if j == c:
                    continue
                rows = rows[self.apart[c, j] <= 4 * own[rows]]  # the others stop here: strictly beyond twice their distance
                if not len(rows):
                    break
                d = ((x[rows] - self.centroids[j]) ** 2).sum(1)
                looked += len(rows)
                nearer = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
                least[rows[nearer]], best[rows[nearer]] = d[nearer], j
        return best, least, looked


def assigned(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """state (vec_id, v, cluster) with the nearest cluster, its squared distance and the number of distances worked out in the batch's first row (0 in others)."""
    near = Neighbours(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            x = v.flatten().to_numpy().reshape(len(v), -1).astype(np.int64)
            cluster, distance, looked = near.nearest(x, b.column(2).to_numpy().astype(np.int64))
            cost = np.zeros(len(v), np.int64)
            cost[0] = looked
            yield pa.RecordBatch.from_arrays([b.column(0), v, pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(cost)], ["vec_id", "v", "cluster", "distance", "looked"])

    return state.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id bigint, v array<int>, cluster int, distance bigint, looked bigint")


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid with members at their floored mean."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # a row per centroid
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(centroids.shape[1])]
    return out


def cluster(embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance, looked as a table, the final centroids)."""
    state = written(vectors(embeddings, dimensions, scale).withColumn("cluster", F.lit(0)), "vectors")
    centroids = first_centroids(state, k, seed)
    if not len(centroids):
        return state.withColumn("distance", F.lit(0).cast("bigint")).withColumn("looked", F.lit(0).cast("bigint")), centroids
    for step in range(rounds + 1):
        after = written(assigned(state, centroids), "vectors")
        discard(state)
        state = after
        if step < rounds:
            centroids = moved(state, centroids)
    return state, centroids


def query(spark, sf_dir) -> DataFrame:
    state, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    own = [(j, sums[j], sum(sums.values()), digest(c)) for j, c in enumerate(centroids.tolist()) if j in sums]
    named = F.broadcast(spark.createDataFrame(own, "c int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return state.join(named, F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {"op12_sort_means": query}


def _sql() -> str:
    """Each round as a table of vectors with the nearest centroid, by all k distances."""
    d = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::bigint"
    parts = [f"""
with v0 as (select vec_id, embedding e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as materialized (select row_number() over () r, vec_id, list_transform(e, lambda x: floor(64 * x::double)::bigint) v from v0),
c0 as materialized (select (row_number() over (order by sha256('1:' || vec_id), v) - 1)::int j, v c from v order by sha256('1:' || vec_id), v limit 16)"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        parts.append(f"a{k} as materialized (select r, j, d from (select r, j, d, row_number() over (partition by r order by d, j) nth from (select r, j, {d} d from v, c{k})) where nth = 1)")
        if k < ROUNDS:
            parts.append(f"m{k} as (select j, list(floor_mean order by i) c from (select j, i, (s // n - case when s % n < 0 then 1 else 0 end)::bigint floor_mean from (select j, i, sum(x)::bigint s, count(*) n from (select j, unnest(v) x, unnest(range(1, 65)) i from a{k} join v using (r)) group by j, i)) group by j)")
            parts.append(f"c{k + 1} as materialized (select j, coalesce(m{k}.c, c{k}.c) c from c{k} left join m{k} using (j))")
    last = f"select vec_id, j::int \"cluster\", d distance, (sum(d) over (partition by j))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, sha256(array_to_string(c, ',')) centroid_sha256 from a{ROUNDS} join v using (r) join c{ROUNDS} using (j)"
    return ",\n".join(parts) + "\n" + last


SQL = {"op12_sort_means": _sql()}
