"""Substring dedup by a log-structured fingerprint index.

A window is WINDOW consecutive words.  Its fingerprint is the least hash of the
K-word grams in it, so equal windows have equal fingerprints, while neighbouring
windows mostly share one: the index holds about a fifth as many rows as there are
windows.

The index is a folder of immutable runs, Parquet in buckets by fingerprint, sorted
in each, one file a bucket.  A manifest names the runs; a later session opens the
folder and goes on.  Adding a batch writes its own run, which is merge-joined with
the older ones, bucket by bucket: no run is shuffled or sorted again.  FANOUT runs
of a level are merged, again bucket by bucket, to one of the next before the next
batch.

Fingerprints that meet in two documents are verified: the texts of documents that
hold them are read again, every window with such a fingerprint gives a row of its
own 128-bit digest, and a window counts as a repeat if that occurs in a document
with a smaller doc_id.  Texts that are copies of an earlier text as a whole are
known by digest, by runs of the same kind, and aren't verified window by window.

A row of a run holds the documents of one slice that have the fingerprint, so a
common one gives a row a slice rather than a document.  Rows of LOCAL_HOT documents
and more are dealt to buckets at random (their `fp` says what they hold), and are
joined by exchanges, whose hot keys AQE can split; so no bucket holds them all.

Batches are to be added in ascending doc_id; what a batch loses is final.

Cases: text null has no words; doc_id null is neither judged nor a source; rows
that share a doc_id are one document, so they lose nothing to each other; texts of
under WINDOW words lose nothing; an empty batch adds an empty run; further columns
are left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, discard, fresh_dir, key_bounds, lists, parts_for, pick, read_text, release, table, text_slices, work_names, write_text, written
from .op4_decontam import Members
from .words import Words, covered, mix, sliding

WINDOW, K, FANOUT, BATCHES, LOCAL_HOT = 13, 6, 2, 3, 8
_U = np.uint64


def windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows, their fingerprints)."""
    grams, valid = w.grams(K)
    width = WINDOW - K + 1
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = sliding(np.minimum, grams, width)
    at = np.flatnonzero(w.doc[: len(least)] == w.doc[WINDOW - 1 : WINDOW - 1 + len(least)])
    return at, least[at]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, digest) -> (key, fp, docs): by fingerprint the documents of a slice, ascending; fp is null where key is the fingerprint.

    Of copies in the slice the least doc_id stands for all."""
    for b in text_slices(batches, "text"):
        w = Words(b.column(1))
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        least_of: dict[bytes, int] = {}
        digests = b.column(2).to_pylist()
        for i, d in zip(ids.tolist(), digests):
            least_of[d] = min(i, least_of.get(d, i))
        first = np.array([least_of[d] == i for i, d in zip(ids.tolist(), digests)], bool)
        at, fp = windows(w)
        doc = w.doc[at]
        own = first[doc]
        fp, own_ids = fp[own], ids[doc[own]]
        order = np.lexsort((own_ids, fp))
        fp, own_ids = fp[order], own_ids[order]
        new = np.ones(len(fp), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (own_ids[1:] != own_ids[:-1])
        fp, own_ids = fp[new], own_ids[new]
        edge = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.zeros(0, np.int64)
        many = np.diff(np.append(edge, len(fp)))
        names, hot = fp[edge], many >= LOCAL_HOT
        keys = np.where(hot, mix(names ^ mix(own_ids[edge].astype(np.uint64))), names)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(names.view(np.int64), mask=~hot), lists(own_ids, many, pa.int64())], ["key", "fp", "docs"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, tag, fresh, fps) -> a row for each window whose fingerprint is wanted."""
    for b in text_slices(batches, "text"):
        w = Words(b.column(1))
        at, least = windows(w)
        spot, _ = Members(b.column(4).flatten().to_numpy(zero_copy_only=False).view(np.uint64)).find(least)
        at = at[spot]
        doc = w.doc[at]
        took = pa.array(doc)
        digest = [pa.array(w.grams_at(at, WINDOW, second).view(np.int64)) for second in (False, True)]
        yield pa.RecordBatch.from_arrays([*digest, b.column(0).take(took), b.column(2).take(took), b.column(3).take(took), pa.array((at - w.off[doc]).astype(np.int32))], ["hash", "second", "doc_id", "tag", "fresh", "at"])


def _docs(docs: DataFrame) -> DataFrame:
    """With digest, of the text, and tag, a short one that parts texts of one doc_id."""
    return _tagged(pick(docs, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint")))


def _tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))).withColumn("tag", F.hash("digest"))


#: Runs are read in their order, and in buckets wherever they are read.  Spark 4.1 takes a union of bucketed column batches
#: for dealt by bucket, which it isn't (counts by key come out twice), so unions count for undealt;
_PLAN = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.execution.replaceHashWithSortAgg": "true", "spark.sql.unionOutputPartitioning": "false"}
#: but runs are merged as rows, whose union does put equal buckets together (one file a bucket; were it otherwise, runs would have more, and be sorted when read).
_MERGE = _PLAN | {"spark.sql.unionOutputPartitioning": "true", "spark.sql.parquet.enableVectorizedReader": "false"}
_KINDS = {"runs": ("key", "key bigint, fp bigint, docs array<bigint>"), "texts": ("digest", "digest binary, first bigint")}


@contextmanager
def _planned(spark: SparkSession, plan: dict[str, str] = _PLAN):
    before = {k: spark.conf.get(k, None) for k in plan}
    for k, v in plan.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class FingerprintIndex:
    """home: its folder.  runs: fingerprints and the documents that hold them; texts: digest and least doc_id of all distinct texts so far; both as (level, name)."""

    def __init__(self, spark: SparkSession, home: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout, self.home = spark, fanout, home or fresh_dir(spark, "index")
        versions = [x for x in work_names(spark, self.home) if x.startswith("manifest-") and x.endswith(".json")]
        self.version = max((int(x[9:-5]) for x in versions), default=-1)
        self.buckets = parts_for(spark)
        self.levels: dict[str, list[tuple[int, str]]] = {"runs": [], "texts": []}
        if self.version >= 0:
            m = json.loads(read_text(spark, f"{self.home}/manifest-{self.version:08d}.json"))
            self.buckets, self.levels = m["buckets"], {k: [(level, name) for level, name in m[k]] for k in _KINDS}

    def _table(self, kind: str, name: str) -> DataFrame:
        """A run, known to the session's catalogue only for its buckets: the folder is all there is."""
        key, schema = _KINDS[kind]
        self.spark.sql(f"create table if not exists {name} ({schema}) using parquet clustered by ({key}) sorted by ({key}) into {self.buckets} buckets location '{self.home}/{name}'")
        return self.spark.table(name)

    def _write(self, kind: str, rows: DataFrame) -> str:
        """A sorted immutable run, one file a bucket, of rows that are dealt by bucket."""
        name, key = f"quarry_{uuid.uuid4().hex}", _KINDS[kind][0]
        rows.write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.home}/{name}").saveAsTable(name)
        return name

    def _commit(self, gone: list[str]) -> None:
        """The manifest, then what it no longer names is deleted."""
        self.version += 1
        write_text(self.spark, f"{self.home}/manifest-{self.version:08d}.json", json.dumps({"buckets": self.buckets, **self.levels}))
        for name in gone:
            self.spark.sql(f"drop table if exists {name}")
            delete(self.spark, f"{self.home}/{name}")
        if self.version:
            delete(self.spark, f"{self.home}/manifest-{self.version - 1:08d}.json")

    def _parts(self, run: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows in the bucket of their fingerprint, the others): fp, docs."""
        return run.filter("fp is null").select(F.col("key").alias("fp"), "docs"), run.filter("fp is not null").select("fp", "docs")

    def meeting(self, own: DataFrame) -> DataFrame:
        """Fingerprints of a run that stand in two of its documents, or in an older run; merge joins by bucket."""
        cold, hot = self._parts(own)
        low, high = F.min(F.array_min("docs")), F.max(F.array_max("docs"))
        common = hot.groupBy(F.col("fp").alias("h_fp")).agg(low.alias("h_a"), high.alias("h_b"))
        mine = cold.groupBy("fp").agg(low.alias("a"), high.alias("b")).join(common, F.col("fp") == F.col("h_fp"), "full_outer")
        mine = mine.select(F.coalesce("fp", "h_fp").alias("fp"), (F.least("a", "h_a") < F.greatest("b", "h_b")).alias("met"))
        olds = [self._parts(self._table("runs", name)) for _, name in self.levels["runs"]]
        seen = [c.select(F.col("fp").alias("o_fp")).distinct() for c, _ in olds]
        if olds:
            seen.append(reduce(DataFrame.unionAll, [h.select(F.col("fp").alias("o_fp")) for _, h in olds]).distinct())
        for s in seen:
            mine = mine.join(s, F.col("fp") == F.col("o_fp"), "left").select("fp", (F.col("met") | F.col("o_fp").isNotNull()).alias("met"))
        return mine.filter("met").select("fp")

    def add(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        """Indexes the batch.  Returns (doc_id, tag, at array<int>) of repeated windows, at null where the whole text is a repeat.

        history: all documents added before, whose texts verification reads again."""
        with _planned(self.spark):
            self.compact()
            return self._add(batch, history)

    def _add(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        spark, n = self.spark, self.buckets
        fresh = _docs(batch)
        first = fresh.groupBy("digest").agg(F.min("doc_id").alias("first")).withColumn("known", F.lit(False))
        for _, name in self.levels["texts"]:  # a digest stands in one run only
            old = self._table("texts", name).select(F.col("digest").alias("o_digest"), F.col("first").alias("o_first"))
            first = first.join(old, F.col("digest") == F.col("o_digest"), "left").select("digest", F.least("first", "o_first").alias("first"), (F.col("known") | F.col("o_first").isNotNull()).alias("known"))
        first = written(first, "first")
        texts = self._write("texts", first.filter("not known").select("digest", "first").repartition(n, "digest"))
        own = self._write("runs", fresh.select("doc_id", "text", "digest").mapInArrow(_postings, _KINDS["runs"][1]).repartition(n, "key"))
        release(spark)
        named = fresh.select("doc_id", "digest").distinct().join(first, "digest").withColumn("copy", F.col("doc_id") > F.col("first")).drop("first", "known")
        named = written(named, "named")
        meet = written(self.meeting(self._table("runs", own)), "meet")
        release(spark)
        held = [p for _, name in [*self.levels["runs"], (0, own)] for p in self._parts(self._table("runs", name))]
        pairs = reduce(DataFrame.unionAll, [p.join(meet, "fp") for p in held]).select("fp", F.explode("docs").alias("doc_id"))
        wanted = written(pairs.groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "wanted")  # at most a document's own
        release(spark)
        rows = fresh.join(wanted.join(named.filter("not copy"), "doc_id").select("doc_id", "digest", "fps"), ["doc_id", "digest"]).withColumn("fresh", F.lit(True))
        if history is not None:
            old = pick(history, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
            old = old.join(wanted, "doc_id").withColumns({"fresh": F.lit(False), "tag": F.lit(0), "digest": F.lit(None).cast("binary")})  # only what the batch holds is judged
            rows = rows.unionByName(old)
        rows = rows.select("doc_id", "text", "tag", "fresh", "fps").mapInArrow(_window_rows, "hash bigint, second bigint, doc_id bigint, tag int, fresh boolean, at int")
        rows = written(rows, "windows")
        release(spark)
        least = rows.groupBy("hash", "second").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
        least = written(least.select("hash", "second", "first"), "least")
        release(spark)
        again = rows.filter("fresh").join(least, ["hash", "second"]).filter("first < doc_id")
        found = again.groupBy("doc_id", "tag").agg(F.collect_set("at").alias("at"))
        whole = fresh.select("doc_id", "digest").distinct().join(named.filter("copy"), ["doc_id", "digest"], "left_semi").select("doc_id", F.hash("digest").alias("tag"), F.lit(None).cast("array<int>").alias("at"))
        out = written(found.unionByName(whole), "repeats")
        self.levels["runs"].append((0, own))
        self.levels["texts"].append((0, texts))
        self._commit([])
        discard(first, named, meet, wanted, rows, least)
        release(spark)
        return out

    def compact(self) -> None:
        """Merges the runs of any level that has `fanout` of them, bucket by bucket."""
        with _planned(self.spark, _MERGE):
            for kind, levels in self.levels.items():
                while True:
                    full = next((x for x, _ in levels if sum(level == x for level, _ in levels) >= self.fanout), None)
                    if full is None:
                        break
                    old = [name for level, name in levels if level == full]
                    both = reduce(DataFrame.unionAll, [self._table(kind, name) for name in old])
                    merged = self._write(kind, both.sortWithinPartitions(_KINDS[kind][0]))
                    levels[:] = [x for x in levels if x[0] != full] + [(full + 1, merged)]
                    self._commit(old)

    def close(self) -> None:
        """Forgets the runs in the session's catalogue; the folder stays."""
        for levels in self.levels.values():
            for _, name in levels:
                self.spark.sql(f"drop table if exists {name}")

    def drop(self) -> None:
        self.close()
        delete(self.spark, self.home)


def cleaned(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """docs' doc_id, n_words, n_removed and the kept words joined by one space."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            w = Words(b.column(1))
            at = b.column(2)
            many = np.diff(at.offsets.to_numpy())
            starts = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.off[:-1], many)
            gone = covered(starts, WINDOW, len(w.hash))
            for d in np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False)).tolist():
                gone[w.off[d] : w.off[d + 1]] = w.counts[d] >= WINDOW
            removed = np.bincount(w.doc[gone], minlength=len(w.counts))
            data, texts = w.data.tobytes(), []
            starts, ends, kept = w.starts.tolist(), w.ends.tolist(), ~gone
            for d in range(len(w.counts)):
                places = (np.flatnonzero(kept[w.off[d] : w.off[d + 1]]) + w.off[d]).tolist()
                texts.append(b" ".join([data[starts[i] : ends[i]] for i in places]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    d = _tagged(pick(docs, "doc_id", "text")).drop("digest")
    r = repeats.select("doc_id", "tag", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.col("at").isNull().alias("whole"))
    both = d.join(r, ["doc_id", "tag"], "left").select("doc_id", "text", F.coalesce("at", F.array().cast("array<int>")).alias("at"), F.coalesce("whole", F.lit(False)).alias("whole"))
    return both.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, text string")


def dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Adds docs to a fresh index in `batches` by ascending doc_id; doc_id, n_words, n_removed, text (what is kept)."""
    index = FingerprintIndex(docs.sparkSession)
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    bounds = [None, *key_bounds(d, "doc_id", batches), None]
    found = []
    for low, high in zip(bounds, bounds[1:]):
        batch = d if high is None else d.filter(F.col("doc_id") <= high)
        batch = batch if low is None else batch.filter(F.col("doc_id") > low)
        found.append(index.add(batch, None if low is None else d.filter(F.col("doc_id") <= low)))
    index.drop()
    return cleaned(d, reduce(DataFrame.unionAll, found))


def query(spark, sf_dir) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": query}
SQL = {
    "op7_substring_dedup": r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 12], ' ') g from d, lateral (select unnest(range(1, (len(w) - 11)::bigint)) i) where len(w) >= 13),
f as (select g, min(doc_id) m from g group by g),
r as (select doc_id, unnest(range(i, i + 13)) p from g join f using (g) where m < doc_id),
x as (select doc_id, list(distinct p) ps from r group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(len(ps), 0)::bigint n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda v, i: not list_contains(coalesce(ps, []), i)), ' '), '')) kept_sha256
from d left join x using (doc_id)"""
}
