"""Structured Streaming: incremental counts, feedback log, watched folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import store


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """A file or folder `name` of Parquet under `folder` as a stream.  NTZ times become UTC timestamps, which watermarks need."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    part = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True)
    try:
        s = part.option("pathGlobFilter", "*.parquet").parquet(path)
        s.isStreaming
    except Exception:  # a single file: watch its folder for that name
        s = part.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    for f in schema:
        if f.dataType.typeName() == "timestamp_ntz":
            s = s.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return s


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tumbling hours by type, late rows up to `delay`."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def drain(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs what there is (availableNow), batch by batch, with exactly-once bookkeeping in `checkpoint`."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()


class Upserts:
    """A keyed table, kept as snapshots: each batch is merged with the last one and written beside it.

    Of a key's rows in a batch that with the greatest `stamp` counts (the column beside the keys, if there is one only).  After a restart the last whole snapshot in `home` goes on;
    a batch that comes again, as after a lost commit, is merged with the snapshot before it."""

    def __init__(self, spark: SparkSession, home: str, keys: list[str], schema: str, stamp: str | None = None):
        self.spark, self.home, self.keys, self.schema = spark, home, keys, schema
        others = [c.split()[0] for c in schema.split(", ") if c.split()[0] not in keys]
        if not stamp and len(others) != 1:
            raise ValueError(f"which of {', '.join(others)} says which row is newest?")
        self.stamp = stamp or others[0]

    def versions(self) -> list[int]:
        """Of the snapshots that were written as a whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/v*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(x.getPath().getParent().getName()[1:]) for x in found)

    def table(self, before: int | None = None) -> DataFrame:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.home}/v{known[-1]}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        fresh = store.latest(batch, self.keys, self.stamp)
        old = self.table(number)
        same = [old[k].eqNullSafe(fresh[k]) for k in self.keys]
        merged = old.join(fresh, same, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))
        merged.write.mode("overwrite").parquet(f"{self.home}/v{number}")
        for v in self.versions():
            if v < number - 1:  # the one before stays, for a batch that comes again
                path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/v{v}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def feedback_log(messages: DataFrame) -> DataFrame:
    """What of a stream (or table) of messages is negative feedback."""
    return messages.withColumn("sentiment", text.negative_word(F.col("text"))).filter("sentiment is not null")


def should_sync(last: float | None, now: float, every: float = 30.0) -> bool:
    """T03."""
    return last is None or now - last >= every
