import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import op12_sort_means as S

KIND = "vec_id long, embedding array<float>, cluster int, v string, hash int"


def brute(rows, k, rounds):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((d(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centroids = [[sum(xs) // len(xs) for xs in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == j]) else c for j, c in enumerate(centroids)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def rows(n=300):
    r = random.Random(2)
    spots = [[r.uniform(-2, 2) for _ in range(64)] for _ in range(9)]
    out = [(k, [x + r.gauss(0, 0.3) for x in r.choice(spots)]) for k in range(n)]
    out += [(k, out[k][1]) for k in range(20)] + [(900 + k, [0.25] * 64) for k in range(80)] + [(None, [0.5] * 64), (None, [0.25] * 64)]
    return out + [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 65), (1004, [None] + [1.0] * 63), (1005, [math.nan] + [1.0] * 63), (1006, [-math.inf] + [1.0] * 63)]


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 0), (1, 2), (1000, 1)])
def test_by_brute_force(spark, k, rounds):
    data = rows()
    frame = spark.createDataFrame([(*x, 7, "v", 7) for x in data], KIND)
    state, centroids = S.cluster(frame, k, rounds)
    want, means = brute(data, k, rounds)
    got = state.collect()
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str) == sorted(want, key=str)
    assert centroids.tolist() == means
    if k == 16:
        assert sum(r.looked for r in got) < 0.8 * k * len(got)  # most centroids aren't looked at


def test_ties_go_to_the_smaller_number_and_the_scan_stops_strictly_beyond():
    near = S.Neighbours(np.array([[0], [4], [-4], [100]]))
    x = np.array([[2], [-2], [0], [99], [52]])
    for had in range(4):
        best, d, _ = near.nearest(x, np.full(5, had))
        assert best.tolist() == [0, 0, 0, 3, 1] and d.tolist() == [4, 4, 0, 1, 2304]


def test_empty_and_too_large(spark):
    none = spark.createDataFrame([], KIND)
    state, centroids = S.cluster(none)
    assert state.count() == 0 and len(centroids) == 0
    with pytest.raises(Exception, match="a component times 64"):
        S.cluster(spark.createDataFrame([(1, [3e38] * 64, 1, "", 1)], KIND))


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(*x, 7, "v", 7) for x in rows()], KIND).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = S.query(spark, str(tmp_path))
    want, means = brute(rows(), 16, 3)
    assert got.count() == len(want) and got.agg(F.sum("distance") == F.max("inertia")).head()[0]
    sha = {j: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for j, c in enumerate(means)}
    for r in got.collect():
        assert r.centroid_sha256 == sha[r.cluster] and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
