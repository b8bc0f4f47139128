import bisect

import pytest
from pyspark.sql import functions as F

from quarry.llm import common as C


@pytest.mark.parametrize("n", [0, 1, 5, 32, 33, 200])
def test_bucket_of(spark, n):
    bounds = sorted({k * k % 1009 for k in range(n)})
    keys = [None, *range(-3, 1015, 7), *bounds]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", C.bucket_of(F.col("k"), bounds).alias("b")).collect()
    assert all(r.b == (0 if r.k is None else bisect.bisect_left(bounds, r.k)) for r in got)


def test_work_folder_is_the_cluster_s():
    from types import SimpleNamespace

    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "file:///shared/" if k == "spark.checkpoint.dir" else d))
    assert C.fresh_dir(named, "x").startswith("file:///shared/x-")
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d))
    assert C.work_dir(unset).startswith("file:///") and C.work_dir(unset) == C.work_dir(unset)


def test_slices_keep_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["id", "text"])
    parts = list(C.text_slices(iter([b]), "text", 12))
    assert [p.column(0).to_pylist() for p in parts] == [[1, 2], [3], [4, 5]]
