"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item.  Of every run of
WINDOW - K + 1 neighbouring K-word grams, which is what a window holds, the least
hash is kept, on either side alike; so a document and an item that share a window
share a kept gram, and a join of kept grams misses no shared span of WINDOW words.
Each hit is then extended: the windows about it are looked up among the items'.
Items of fewer words are one window each and are looked up by all grams of their
length.  Windows are told apart by two 64-bit hashes
of their words.

Where the benchmark has at most BROADCAST_BYTES of text and BROADCAST_ITEMS rows (checked), its index goes
to every worker; beyond that, kept grams are joined by shuffle, row for row alike.

Cases: text null has no words; items without words have no window; item_id null
is written as "null"; item_ids that repeat count once; an empty benchmark hits
nothing; repeated documents are each judged; further columns are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lists, pick, sheltered, table, text_slices, written
from .words import LOWER, NOT_ALNUM, Words, covered, minimizers

WINDOW, K, BROADCAST_BYTES, BROADCAST_ITEMS = 10, 5, 16 << 20, 200_000
_U = np.uint64


def words(texts: pa.Array) -> Words:
    return Words(texts, NOT_ALNUM, LOWER)


def item_windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, length in words, item's place) of all windows of a slice of items."""
    grams, valid = w.grams(WINDOW)
    at = np.flatnonzero(valid)
    out = [(grams[at], w.grams_at(at, WINDOW, True), np.full(len(at), WINDOW), w.doc[at])]
    for n in range(1, WINDOW):
        d = np.flatnonzero(w.counts == n)
        out.append((w.grams_at(w.off[d], n), w.grams_at(w.off[d], n, True), np.full(len(d), n), d))
    return tuple(np.concatenate(x) for x in zip(*out))


def kept_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that winnowing keeps."""
    grams, valid = w.grams(K)
    at = minimizers(grams, valid, WINDOW - K + 1)
    return at, grams[at]


class Members:
    """Quick membership of many 64-bit hashes in a sorted few: a bit table first, then search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.shift = _U(64 - 20)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values >> self.shift).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x that are members, their places in values)."""
        at = np.flatnonzero(self.bits[(x >> self.shift).astype(np.int64)])
        spot = np.searchsorted(self.values, x[at])
        spot[spot == len(self.values)] = 0
        hit = self.values[spot] == x[at] if len(self.values) else np.zeros(len(at), bool)
        return at[hit], spot[hit]


class BenchmarkIndex:
    def __init__(self, ids: list[str], texts: list[str | None]):
        w = words(pa.array(texts, pa.string()))
        self.names = sorted(set(ids))
        number = {x: i for i, x in enumerate(self.names)}
        own = np.array([number[x] for x in ids], np.int64)
        hashes, seconds, sizes, item = item_windows(w)
        self.grams = Members(kept_grams(w)[1])
        self.by_size = {}
        for n in np.unique(sizes).tolist():
            of = sizes == n
            rows = np.unique(np.stack([hashes[of], seconds[of], own[item[of]].astype(np.uint64)]), axis=1)
            windows, edge = np.unique(rows[:2], axis=1, return_index=True)
            self.by_size[n] = Members(windows[0]), windows, np.append(edge, rows.shape[1]), rows[2].astype(np.int64)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, place in its size's windows) of every window found, by both hashes."""
        out = []
        for n, (members, windows, _, _) in self.by_size.items():
            if n == WINDOW:
                starts = about(w, kept_grams(w), self.grams)
                at, first = members.find(w.grams_at(starts, n))
                at = starts[at]
            else:
                grams, valid = w.grams(n)
                at, first = members.find(grams)
                at, first = at[valid[at]], first[valid[at]]
            spot = np.searchsorted(windows[0], members.values[first])
            second = w.grams_at(at, n, True) if len(at) else np.zeros(0, np.uint64)
            open_ = np.arange(len(at))
            while len(open_):  # a round for each window of one first hash
                same = windows[1, spot[open_]] == second[open_]
                out.append((at[open_[same]], np.full(int(same.sum()), n), spot[open_[same]]))
                open_ = open_[~same]
                spot[open_] += 1
                open_ = open_[spot[open_] < windows.shape[1]]
                open_ = open_[windows[0, spot[open_]] == windows[0, spot[open_] - 1]]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def judge(self, w: Words) -> tuple[np.ndarray, list[list[str]]]:
        """(which words are hit, by text the sorted items that occur)."""
        start, size, spot = self.hits(w)
        hit = np.zeros(len(w.hash), bool)
        items: list[list[str]] = [[] for _ in w.counts]
        found = [np.zeros((2, 0), np.int64)]
        for n, (_, _, edge, item) in self.by_size.items():
            of = size == n
            hit |= covered(start[of], n, len(hit))
            doc, s = np.unique(np.stack([w.doc[start[of]], spot[of]]), axis=1)
            many = edge[s + 1] - edge[s]
            places = np.repeat(edge[s] - np.concatenate([[0], np.cumsum(many)[:-1]]) if len(s) else edge[s], many) + np.arange(many.sum())
            found.append(np.stack([np.repeat(doc, many), item[places]]))
        for d, i in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
            items[d].append(self.names[i])
        return hit, items


def about(w: Words, kept: tuple[np.ndarray, np.ndarray], grams: Members) -> np.ndarray:
    """Starts of the windows that hold a kept gram of the benchmark's."""
    at = kept[0][grams.find(kept[1])[0]]
    starts = np.unique((at[:, None] - np.arange(WINDOW - K + 1)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts + WINDOW <= len(w.hash))]
    return starts[w.doc[starts] == w.doc[starts + WINDOW - 1]]


def runs(hit: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number by text) of the stretches of hit words, as word numbers within their text."""
    n = len(hit)
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1]
    last[:-1] &= ~hit[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[hit[cut] & hit[cut - 1]]
    first[cut], last[cut - 1] = True, True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    return start - off[doc], end - off[doc], np.bincount(doc, minlength=len(off) - 1)


_SPANS = "n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>"


def _columns(w: Words, hit: np.ndarray, items: list[list[str]]) -> list[pa.Array]:
    start, end, many = runs(hit, w.off)
    return [pa.array(w.counts, pa.int64()), lists(start, many, pa.int64()), lists(end, many, pa.int64()), pa.array(items, pa.list_(pa.string()))]


def decontaminate(docs: DataFrame, bench: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with n_words, starts and ends of hit stretches (word numbers, end exclusive), and items (sorted as strings).

    What docs has under these names is replaced."""
    b = pick(bench, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    kept = docs.drop("n_words", "starts", "ends", "items")
    size = b.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item_id")), F.count("*")).head()
    if (size[0] or 0) <= broadcast_bytes and size[1] <= BROADCAST_ITEMS:
        rows = b.collect()  # bounded by the check above
        shared = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for x in text_slices(batches, "text"):
                w = words(x.column(x.schema.get_field_index("text")))
                yield pa.RecordBatch.from_arrays([*x.columns, *_columns(w, *index.judge(w))], [*x.schema.names, "n_words", "starts", "ends", "items"])

        return kept.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), _SPANS]))
    return _by_shuffle(kept, b)


def _by_shuffle(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The same by joins: kept grams first, then the windows about those that meet, then by document."""
    key = [F.col("doc_id").alias("k_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("k_text")]
    sizes = sorted(r[0] for r in bench.mapInArrow(_sizes, "n int").distinct().collect())  # at most WINDOW numbers

    def bench_rows(batches):
        for x in text_slices(batches, "text"):
            w = words(x.column(1))
            h, h2, n, d = item_windows(w)
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(d)), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n, pa.int32())], ["item_id", "hash", "second", "n"])

    def bench_grams(batches):
        for x in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(kept_grams(words(x.column(1)))[1].view(np.int64))], ["gram"])

    def doc_rows(batches):
        for x in text_slices(batches, "text"):
            w = words(x.column(2))
            at, grams = kept_grams(w)
            starts = at[:, None] - np.arange(WINDOW - K + 1)[None, :]
            fine = (starts >= 0) & (starts + WINDOW <= len(w.hash))
            fine[fine] = w.doc[starts[fine]] == w.doc[starts[fine] + WINDOW - 1]
            flat, many = starts[fine], fine.sum(1)
            out = [(at, grams, flat, w.grams_at(flat, WINDOW), many, WINDOW)]
            for n in sizes:
                if n < WINDOW:
                    g, valid = w.grams(n)
                    a = np.flatnonzero(valid)
                    out.append((a, np.zeros(len(a), np.uint64), a, g[a], np.ones(len(a), int), n))
            for a, g, s, h, m, n in out:
                doc = w.doc[a]
                took = pa.array(doc)
                base = np.repeat(w.off[doc], m)
                yield pa.RecordBatch.from_arrays([x.column(0).take(took), x.column(1).take(took), pa.array(g.view(np.int64)), pa.array(np.full(len(a), n), pa.int32()), lists(s - base, m, pa.int64()), lists(h.view(np.int64), m, pa.int64()), lists(w.grams_at(s, n, True).view(np.int64), m, pa.int64())], ["k_id", "k_text", "gram", "n", "at", "hashes", "seconds"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    b_win = written(bench.mapInArrow(bench_rows, "item_id string, hash bigint, second bigint, n int").distinct(), "windows")
    b_gram = written(bench.mapInArrow(bench_grams, "gram bigint").distinct(), "grams")
    found = docs.select(*key, "text").mapInArrow(doc_rows, f"k_id {kind}, k_text string, gram bigint, n int, at array<bigint>, hashes array<bigint>, seconds array<bigint>")
    long = found.filter(F.col("n") == WINDOW).join(b_gram, "gram", "left_semi")
    near = long.unionByName(found.filter(F.col("n") < WINDOW)).select("k_id", "k_text", "n", F.explode(F.arrays_zip("at", "hashes", "seconds")).alias("z"))
    hits = near.select("k_id", "k_text", "n", F.col("z.at").alias("at"), F.col("z.hashes").alias("hash"), F.col("z.seconds").alias("second")).join(b_win, ["hash", "second", "n"])
    hits = written(hits.select("k_id", "k_text", "at", (F.col("at") + F.col("n")).alias("end"), "item_id").distinct(), "hits")
    items = hits.groupBy(F.col("k_id").alias("i_id"), F.col("k_text").alias("i_text")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    own = Window.partitionBy("k_id", "k_text").orderBy("at", "end")  # a document's hits, linear in their number
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = hits.select("k_id", "k_text", "at", "end").distinct().withColumn("fresh", (reach.isNull() | (F.col("at") > reach)).cast("int"))
    stretch = marked.withColumn("stretch", F.sum("fresh").over(own)).groupBy("k_id", "k_text", "stretch").agg(F.min("at").alias("s"), F.max("end").alias("e"))
    merged = stretch.groupBy("k_id", "k_text").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("m"))
    spans = merged.join(items, F.col("k_id").eqNullSafe(F.col("i_id")) & (F.col("k_text") == F.col("i_text"))).select("k_id", "k_text", "items", "m")

    def count(batches):
        for x in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(words(x.column(x.schema.get_field_index("text"))).counts, pa.int64())], [*x.schema.names, "n_words"])

    counted = docs.mapInArrow(count, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words bigint"]))
    with_key = counted.withColumn("k_text", F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = with_key.alias("d").join(spans.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.k_id")) & (F.col("d.k_text") == F.col("s.k_text")), "left")
    none = F.array().cast("array<bigint>")
    return joined.select(
        *[F.col(f"d.`{c}`") for c in counted.columns], F.coalesce(F.col("s.m")["s"], none).alias("starts"), F.coalesce(F.col("s.m")["e"], none).alias("ends"), F.coalesce("s.items", F.array().cast("array<string>")).alias("items")
    )


def _sizes(batches):
    for x in text_slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.minimum(words(x.column(1)).counts, WINDOW)), pa.int32())], ["n"])


def digest(judged: DataFrame) -> DataFrame:
    hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("bigint"), lambda a, x: a + x["ends"] - x["starts"])
    return judged.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window, with their columns as they were."""
    return sheltered(docs, lambda d: decontaminate(d, table(spark, sf_dir, "benchmark")).filter(F.size("starts") == 0))


def query(spark, sf_dir) -> DataFrame:
    return digest(decontaminate(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark")))


QUERIES = {"op4_winnowing_decontamination": query}
SQL = {
    "op4_winnowing_decontamination": r"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
b as (select coalesce(item_id::varchar, 'null') item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + 9], ' ') g from b, lateral (select unnest(range(1, greatest(len(w) - 9, 1) + 1)) i) where len(w) > 0),
ns as (select distinct n from bw),
dg as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g from d, ns, lateral (select unnest(range(1, (len(w) - n + 2)::bigint)) i) where len(w) >= n),
h as (select doc_id, i, n, item_id from dg join bw using (n, g)),
c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from h) group by doc_id),
t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id, ',' order by item_id) s from h group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c using (doc_id) left join t using (doc_id)"""
}
