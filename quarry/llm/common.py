"""Shared plumbing: tables, the shared work folder, Arrow slicing, file access."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reachable

#: Bytes of text that one vectorised step works on; bounds a worker's memory whatever Arrow's batch size is.
SLICE_BYTES = 1 << 20

#: Rows and bytes of an Arrow batch on its way to a worker; a longer text is a batch by itself.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

_own_dir: list[str] = []


def calm(spark: SparkSession) -> None:
    """Whole texts go to Python workers in small Arrow batches, which bounds both sides' memory; and workers find this package."""
    reachable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    calm(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one of this process only where none is set, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="quarry-"))
    return _own_dir[0]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quarry_path = path
    return out


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that reads them is written too."""
    for t in tables:
        delete(t.sparkSession, t.quarry_path)


def work_names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder; nothing if there is none."""
    fs, at = _at(spark, folder)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of the driver's, there as a whole or not at all."""
    fs, part = _at(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.rename(part, _at(spark, path)[1])


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _at(spark, path)
    file = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of queries that are over, rather than whenever the driver next collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str):
    """(file system, path) for Python workers; any scheme pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, by exact name; extra columns of any name do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: What operators read of documents; all other columns are set aside by sheltered().
READ = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(docs: DataFrame, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run(docs) with docs' columns, in which run adds what columns it likes: those it doesn't read have other names meanwhile."""
    names = {c: c if c in READ else f"own{k}_{uuid.uuid4().hex[:8]}" for k, c in enumerate(docs.columns)}
    out = run(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into row ranges of about `limit` bytes of text, at least a row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = lengths(batch.column(batch.schema.get_field_index(column)))
        if sizes.sum() <= limit:
            yield batch
            continue
        ends = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text d is bytes[offsets[d]:offsets[d+1]]; null counts as empty."""
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    if array.null_count:
        array = array.fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and each row's count."""
    flat = pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def key_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 split points of a whole-number key, from a narrow pass; the driver holds these only."""
    found = df.select(F.percentile_approx(F.col(f"`{key}`"), [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("q")).head()
    return sorted(set(found["q"] or [])) if parts > 1 else []


def bucket_of(key, bounds: list[int]):
    """Number of bounds below the key (null: 0), as a column: keys up to and with bounds[i] are in bucket i or lower."""
    if not bounds:
        return F.lit(0)
    if len(bounds) <= 32:
        spots = F.array(*[F.lit(int(b)) for b in bounds])
        return F.when(key.isNull(), F.lit(0)).otherwise(F.size(F.filter(spots, lambda b: b < key)))
    spots = F.from_json(F.lit(str([int(b) for b in bounds])), "array<bigint>")

    def halve(s, _):
        mid = F.floor((s["a"] + s["b"]) / 2).cast("int")
        left = F.coalesce(F.get(spots, mid) >= key, F.lit(True))
        more = s["a"] < s["b"]
        return F.struct(F.when(more & ~left, mid + 1).otherwise(s["a"]).alias("a"), F.when(more & left, mid).otherwise(s["b"]).alias("b"))

    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b")), halve, lambda s: s["a"])
    return F.when(key.isNull(), F.lit(0)).otherwise(found)


def parts_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
