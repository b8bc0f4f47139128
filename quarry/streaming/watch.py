"""A watch loop with state by path.

A pass lists the folder: path, stamp (size and time of the last change), no contents.  The lists are a stream; state keyed by
path holds the stamp that was last acted on, so out of a pass come only the paths that are new, changed or gone, also
after a restart or where a pass comes again.  A batch reads and chunks those files and writes their rows, and nothing else;
which batch counts for a path is in the log beside them.

Cases: an empty folder is a pass without paths, and all that was there goes; a path that comes back is new; of several passes in one batch the
last one counts; a file that goes between the pass and its reading has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources import chunks, files, shared

DELTA = "path string, status string, stamp string, look bigint"
ROWS = "path string, language string, topic string, seq int, start_line int, end_line int, content string, content_hash string"


class ByPath(StatefulProcessor):
    """(path, stamp, look) rows of one path to at most one delta; a stamp that is null says that the path is gone."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "stamp string, look bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.get() if self.last.exists() else None
        newest = max(((int(p), s) for b in rows for p, s in zip(b["look"], b["stamp"])), key=lambda x: x[0])
        number, stamp = newest[0], None if pd.isna(newest[1]) else newest[1]
        if known is not None and number <= known[1] or known is None and stamp is None:
            return
        if stamp is None:
            self.last.clear()
            status = "deleted"
        else:
            self.last.update((stamp, number))
            status = "new" if known is None else "changed" if known[0] != stamp else None
        if status:
            yield pd.DataFrame({"path": [key[0]], "status": [status], "stamp": [stamp], "look": [number]})

    def close(self) -> None:
        pass


class Watch:
    """root: the folder watched; home: where passes, state and rows are kept."""

    def __init__(self, spark: SparkSession, root: str, home: str, options: files.Options | None = None):
        self.spark = spark.newSession()  # the state store's setting is this loop's own
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        self.root, self.home, self.options = root, home.rstrip("/"), options or files.Options()

    def passes(self) -> list[int]:
        return sorted(int(n[5:]) for n in shared.names(self.spark, f"{self.home}/passes") if n.startswith("look="))

    def look(self) -> int:
        """Lists the folder; its number.  Paths of the pass before that aren't there any more come with a null stamp."""
        known = self.passes()
        number = known[-1] + 1 if known else 0
        now = files.listed(self.spark, self.root, self.options).select("path", F.concat_ws(":", "size", "mtime").alias("stamp"))
        if known:
            before = self.spark.read.schema("path string, stamp string, look bigint").parquet(f"{self.home}/passes/look={known[-1]}").filter("stamp is not null")
            now = now.unionByName(before.join(now, "path", "left_anti").select("path", F.lit(None).cast("string").alias("stamp")))
        now.withColumn("look", F.lit(number).cast("bigint")).coalesce(4).write.mode("overwrite").parquet(f"{self.home}/passes/look={number}")
        return number

    def deltas(self) -> DataFrame:
        """The stream of paths that are new, changed or gone."""
        lists = self.spark.readStream.schema("path string, stamp string, look bigint").option("recursiveFileLookup", True).parquet(f"{self.home}/passes")
        return lists.groupBy("path").transformWithStateInPandas(statefulProcessor=ByPath(), outputStructType=DELTA, outputMode="Update", timeMode="None")

    def drain(self) -> None:
        """All passes that weren't acted on yet."""
        q = self.deltas().writeStream.outputMode("update").option("checkpointLocation", f"{self.home}/checkpoint").trigger(availableNow=True).foreachBatch(self._write).start()
        q.awaitTermination()

    def once(self) -> None:
        """A pass, and what follows from it."""
        self.look()
        self.drain()

    def _write(self, batch: DataFrame, number: int) -> None:
        """Idempotent: a batch that comes again is written over."""
        spark = batch.sparkSession
        at = f"{self.home}/log/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        log = spark.read.schema(DELTA).parquet(at)
        stale = log.filter("status <> 'deleted'").select("path")
        few = [r[0] for r in stale.limit(files.NAMED + 1).collect()]
        if few:  # many are not named: the folder is read and joined, and what is written is the same
            found = files.crawl(spark, self.root, self.options, few if len(few) <= files.NAMED else None)
            rows = chunks.chunk(found.join(stale, "path", "left_semi") if len(few) > files.NAMED else found, self.options.max_chunk_bytes)
            rows.write.mode("overwrite").parquet(f"{self.home}/rows/batch={number}")

    def log(self) -> DataFrame:
        if not shared.names(self.spark, f"{self.home}/log"):
            return self.spark.createDataFrame([], f"{DELTA}, batch int")
        return self.spark.read.schema(f"{DELTA}, batch int").parquet(f"{self.home}/log")

    def table(self) -> DataFrame:
        """The chunks of all files as they are: of each path those of its last batch, none if it is gone."""
        if not shared.names(self.spark, f"{self.home}/rows"):
            return self.spark.createDataFrame([], ROWS)
        last = self.log().groupBy("path").agg(F.max_by(F.struct("batch", "status"), "batch").alias("last")).filter("last.status <> 'deleted'")
        rows = self.spark.read.schema(f"{ROWS}, batch int").parquet(f"{self.home}/rows")
        return rows.join(last.select("path", F.col("last.batch").alias("batch")), ["path", "batch"]).select(*[c.split()[0] for c in ROWS.split(", ")])
