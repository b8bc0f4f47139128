"""Best-two-fit packing of whole documents into sequences of `size` tokens.

A document is its ids and an end id; one of more than `size` is cut into pieces of
`size`, the first of which may be shorter.  A bin is filled greedily, with the longest
piece left that fits, until none does; then its shortest piece is given back if two
pieces that are left fill the widened gap more tightly.

Only lengths matter to that, and there are at most `size` of them.  So the plan is made
from the number of pieces of each length: what a bin takes depends on which lengths are
left, hence the same bin is taken as many times as the counts allow, at once, and the
bins are those that packing one by one gives.  Its length doesn't grow with the corpus.
A piece finds its place by its number among the pieces of its length: its number
in the task that tokenised it, and how many such pieces earlier tasks have.  So no piece
has to be moved for that, and a length that a third of all pieces share is no hot group.

Cases: text null or empty is the end id alone; doc_id null is packed like any other;
rows that share a doc_id, and repeated rows, are each packed; an empty table gives no
row; strings of the vocabulary's added tokens get their own ids, as the library has it;
further columns are left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, pick, table, text_slices, written
from .op8_shards import VOCABULARY, _words, encode

SIZE, END_ID = 1024, 2
_PIECES = "task int, length int, nth bigint, doc_id bigint, piece int, start bigint, ids binary"
_PLAN = "length int, first bigint, past bigint, times int, sequence bigint, at int"


def cut(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of n tokens each."""
    many = -(-n // size)
    doc = np.repeat(np.arange(len(n)), many)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    short = (n - (many - 1) * size)[doc]
    start = np.where(piece, short + (piece - 1) * size, 0)
    return doc, start, np.where(piece, size, short)


def pieces(docs: DataFrame, size: int = SIZE, name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """The pieces with their ids (little-endian, 16-bit if the vocabulary allows it, else 32-bit), as a table; nth numbers a task's pieces of
    one length from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        width = _words(name)[1]
        end = end_id.to_bytes(width, "little")
        for b in text_slices(batches, "text"):
            ids = encode(b.column(1).to_pylist(), name, added=True)
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // width + 1
            flat = end.join(ids) + end
            doc, start, length = cut(n, size)
            order = np.argsort(length, kind="stable")
            run_of = length[order]
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.searchsorted(run_of, run_of) + seen[run_of]
            seen += np.bincount(length, minlength=size + 1)
            first = np.cumsum(n) - n
            piece = np.arange(len(doc)) - np.searchsorted(doc, doc)
            most = max(1, SLICE_BYTES // (width * size))  # pieces at a time: a long text has many
            for a in range(0, len(doc), most):
                z = slice(a, a + most)
                lo = first[doc[z]] + start[z]
                bounds = np.append(lo, lo[-1] + length[z][-1])  # pieces follow each other without a gap
                data = pa.py_buffer(flat[bounds[0] * width : bounds[-1] * width])
                offsets = pa.py_buffer(((bounds - bounds[0]) * width).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(lo), task, np.int32)),
                        pa.array(length[z].astype(np.int32)),
                        pa.array(nth[z]),
                        b.column(0).take(pa.array(doc[z])),
                        pa.array(piece[z].astype(np.int32)),
                        pa.array(start[z]),
                        pa.Array.from_buffers(pa.binary(), len(lo), [None, offsets, data]),
                    ],
                    ["task", "length", "nth", "doc_id", "piece", "start", "ids"],
                )

    d = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(d.mapInArrow(run, _PIECES), "pieces")


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how many such bins, lengths of the pieces in it), in the order of packing; counts: pieces by length, 1 to size."""
    left = {k: v for k, v in counts.items() if v > 0}
    known = sorted(left)
    if known and not 1 <= known[0] <= known[-1] <= size:
        raise ValueError(f"pieces have 1 to {size} tokens")
    out = []
    while known:
        used: dict[int, int] = {}
        bin_, gap = [], size
        at = len(known) - 1
        while gap:
            at = min(at, bisect_right(known, gap) - 1)
            while at >= 0 and left[known[at]] <= used.get(known[at], 0):
                at -= 1
            if at < 0:
                break
            x = known[at]
            take = min(gap // x, left[x] - used.get(x, 0))
            used[x] = used.get(x, 0) + take
            bin_ += [x] * take
            gap -= x * take
        most = dict(used)  # what a bin needs to be left, so as to be filled like this
        pair = _pair(known, left, used, bin_[-1], bin_[-1] + gap) if gap else None
        if pair:
            used[bin_[-1]] -= 1
            bin_[-1:] = pair
            for x in pair:
                used[x] = used.get(x, 0) + 1
                most[x] = max(most.get(x, 0), used[x])
        times = min((left[x] - most[x]) // u + 1 for x, u in used.items() if u)
        out.append((times, bin_))
        for x, u in used.items():
            left[x] -= times * u
            if not left[x]:
                known.remove(x)
    return out


def _pair(known: list[int], left: dict[int, int], used: dict[int, int], over: int, room: int) -> list[int] | None:
    """Of two unpacked pieces of more than `over` and at most `room` together, the fullest; of those, the one with the longest piece."""
    free = [x for x in known if left[x] > used.get(x, 0)]
    best, pair = over, None
    i, j = 0, len(free) - 1
    while i <= j:
        total = free[i] + free[j]
        if total > room:
            j -= 1
            continue
        if total > best and (i < j or left[free[i]] - used.get(free[i], 0) > 1):
            best, pair = total, [free[j], free[i]]
        i += 1
    return pair


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Where pieces go: those of `length` numbered first to past - 1, `times` to a sequence, from sequence number `sequence` on, at `at`."""
    out, given, sequence = [], dict.fromkeys(counts, 0), 0
    for times, bin_ in best_two_fit(counts, size):
        at, runs = 0, {}
        for x in sorted(bin_, reverse=True):
            runs.setdefault(x, [at, 0])[1] += 1
            at += x
        for x, (begin, many) in runs.items():
            out.append((x, given[x], given[x] + times * many, many, sequence, begin))
            given[x] += times * many
        sequence += times
    return out


def places(cut_: DataFrame, size: int = SIZE) -> DataFrame:
    """task, length, lo, hi: the task's pieces of this length numbered lo to hi - 1 are `skip` and more into a run of the plan.

    The driver sees one count for each length, at most `size`, and the plan, whose length is bounded by `size` alone."""
    spark = cut_.sparkSession
    own = cut_.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = written(own.withColumn("base", before), "piece-counts")
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = F.broadcast(spark.createDataFrame(plan(counts, size), _PLAN))
    meet = (own["length"] == runs["length"]) & (F.col("base") < F.col("past")) & (F.col("base") + F.col("n") > F.col("first"))
    lo, hi = F.greatest(F.col("first") - F.col("base"), F.lit(0)), F.least(F.col("past") - F.col("base"), F.col("n"))
    return own.join(runs, meet).select("task", own["length"], lo.alias("lo"), hi.alias("hi"), (F.col("base") - F.col("first")).alias("skip"), "times", "sequence", "at")


def pack(docs: DataFrame, size: int = SIZE, name: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, as of pieces()), sequence_id, offset: a row for each piece."""
    cut_ = pieces(docs, size, name, end_id)
    spots = places(cut_, size).withColumnsRenamed({"task": "s_task", "length": "s_length"})
    found = cut_.join(spots, (F.col("task") == F.col("s_task")) & (F.col("length") == F.col("s_length")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
    number = F.col("nth") + F.col("skip")  # among the run's pieces
    return found.select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids",
        (F.col("sequence") + F.floor(number / F.col("times"))).alias("sequence_id"),
        (F.col("at") + F.pmod(number, F.col("times")) * F.col("length")).cast("bigint").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, doc_ids, ids: each sequence's ids in one binary, ready to be written; a sequence is at most `size` tokens."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return rows.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"))


def digests(packed: DataFrame) -> DataFrame:
    """packed with ids_crc32, of the ids as little-endian unsigned 32-bit numbers, in place of ids."""
    own = [c for c in packed.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = b.column(0).to_pylist(), b.column(b.schema.get_field_index("length")).to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, f"<u{len(x) // k}").astype("<u4")) for x, k in zip(ids, n)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(crc, pa.int64())], [*own, "ids_crc32"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.select(*own).schema)
    return packed.select("ids", *own).mapInArrow(run, f"{kinds}, ids_crc32 bigint")


def query(spark, sf_dir) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op11_best_two_fit": query}
