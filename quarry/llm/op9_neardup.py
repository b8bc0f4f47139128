"""Near-duplicates by one-permutation MinHash.

A document's set holds its distinct SHINGLE-word shingles, as 64-bit hashes.
Documents with one set are one node.  Its name has 64 bits, and 64 more tell
whether two sets share a name; where any do, they are named anew.  One permutation deals the set's hashes into
BINS bins, the least of each counts; an empty bin takes the value of the first
filled bin in a random order of its own (optimal densification: the same in every
document, and unlike bins choose independently).  ROWS bins make a band: sets with
a likeness of 0.8 miss each other in all BANDS bands with odds of 3 in a million.

In each bucket of a band, edges lead from one hub to all others, so a bucket of n
nodes gives n - 1 candidate pairs.  The hub is the node that shares most buckets,
the centre of a family.  Each pair's sets are then compared in full.

A star can miss a link between two nodes neither of which is a hub.  So nodes of
buckets that still hold more than one component are joined once more, by an exact
prefix filter over their sets (rarest shingles first; see `_prefixes`), which loses
no pair.

Cases: texts without words, or null, have an empty set and are linked with
nothing; fewer words than a shingle are one shingle; doc_id null joins in, but
names no component unless all its members lack one; rows that share a doc_id are
each judged by their own text; further columns are left.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import calm, discard, lists, pick, release, sheltered, table, text_slices, written
from .components import components
from .words import LOWER, SPACE, Words, mix

#: Words of a shingle: five, but four where op9's contract binds the query.
SHINGLE, QUERY_SHINGLE, ROWS, BANDS, PERCENT = 5, 4, 5, 32, 80
BINS = ROWS * BANDS
_U = np.uint64
_ORDER = np.stack([np.random.default_rng([9, j]).permutation(BINS) for j in range(BINS)])
_BAND = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def sets(w: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    grams, _ = w.grams(size)
    out = []
    off = w.off.tolist()
    for a, b in zip(off, off[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(w.grams_at(np.array([a]), b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> tuple[int, int]:
    """A 64-bit name of the set, and 64 bits that check it."""
    return struct.unpack("<qq", hashlib.blake2b(s.tobytes(), digest_size=16).digest())


def signature(s: np.ndarray) -> np.ndarray:
    """BINS values of a set that isn't empty."""
    bins = ((s >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)  # ascending, as s is
    first = np.ones(len(s), bool)
    first[1:] = bins[1:] != bins[:-1]
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], filled[bins[first]] = s[first], True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return out


def bands(s: np.ndarray) -> np.ndarray:
    sig = signature(s).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for r in range(ROWS):
        key = key * _U(0xD6E8FEB86659FD93) + sig[:, r]
    return mix(key)


def _words(texts: pa.Array) -> Words:
    return Words(texts, SPACE, LOWER)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            found = sets(_words(b.column(1)), size)
            n = [len(s) for s in found]
            keys = [bands(s) if len(s) else np.zeros(0, np.uint64) for s in found]
            names = [node_of(s) if len(s) else (None, None) for s in found]
            nodes = [pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *nodes, lists(np.concatenate(keys).view(np.int64), np.array([len(k) for k in keys]), pa.int64()), *b.columns[2:]], ["doc_id", "n", "node", "sure", "bands", *b.schema.names[2:]])

    return run


def _set_rows(size: int):
    """(text, node, sure): the node's set, where the text is indeed that node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            found = sets(_words(b.column(0)), size)
            nodes, sure = b.column(1).to_pylist(), b.column(2).to_pylist()
            take = [i for i, s in enumerate(found) if len(s) and node_of(s)[1] == sure[i]]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in take], pa.int64()), pa.array([len(found[i]) for i in take], pa.int64()), pa.array([found[i].tobytes() for i in take], pa.binary())], ["node", "n", "s"])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, a, b): the pairs whose sets are alike enough."""
    for x in batches:
        keep = []
        for i, (a, b) in enumerate(zip(x.column(2), x.column(3))):
            a, b = (np.frombuffer(y.as_buffer(), np.uint64) for y in (a, b))
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * shared >= PERCENT * (len(a) + len(b) - shared):
                keep.append(i)
        yield x.select(["u", "v"]).take(pa.array(keep, pa.int64()))


def _alike(small, large):
    return 100 * F.least(small, large) >= PERCENT * F.greatest(small, large)


def _verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
    one = members.select(F.col("node").alias("v"), F.col("s").alias("b"))
    two = members.select(F.col("node").alias("u"), F.col("s").alias("a"))
    return pairs.join(one, "v").join(two, "u").select("u", "v", "a", "b").mapInArrow(_compare, "u bigint, v bigint")


def _prefixes(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Candidate pairs among members (node, n, s), exact for the likeness of PERCENT; and the tables they are read from.

    In the order of rarity a set's first n - ceil(0.8 n) + 1 shingles meet any set as
    alike and no longer in one of that one's first m - ceil(8/9 m) + 1; and what can
    still be shared from the first meeting place on must suffice.  Shingles of one
    member only stand first and meet nothing."""

    def explode(batches):
        for b in batches:
            s = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(2)]
            at = pa.array(np.repeat(np.arange(len(s)), [len(x) for x in s]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(s))], ["node", "n", "shingle"])

    rows = written(members.mapInArrow(explode, "node bigint, n bigint, shingle bigint"), "shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    order = rows.join(common, "shingle").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("c"))  # at most a set
    probe = F.expr("n - ceil(0.8 * n) + 1 - (n - size(c))").cast("int")
    order = order.select("node", "n", F.expr("n - size(c)").alias("lone"), F.slice("c", 1, F.greatest(probe, F.lit(0))).alias("c")).filter(F.size("c") > 0)
    p = order.join(roots, "node", "left").select("node", "n", "lone", F.coalesce("root", "node").alias("root"), F.posexplode("c").alias("i", "x"))
    p = written(p.select("node", "n", "root", (F.col("lone") + F.col("i")).alias("i"), F.col("x.shingle").alias("shingle")), "prefixes")
    x = p.select(F.col("node").alias("u"), F.col("n").alias("x_n"), F.col("root").alias("x_root"), F.col("i").alias("x_i"), "shingle")
    y = p.filter("i < n - ceil(160 * n / 180) + 1").select(F.col("node").alias("v"), F.col("n").alias("y_n"), F.col("root").alias("y_root"), F.col("i").alias("y_i"), "shingle")
    left = F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i"))
    meet = (F.col("x_root") != F.col("y_root")) & (F.struct("y_n", "v") < F.struct(F.col("x_n").alias("y_n"), F.col("u").alias("v"))) & _alike(F.col("x_n"), F.col("y_n")) & (180 * left >= 80 * (F.col("x_n") + F.col("y_n")))
    return x.join(y, "shingle").filter(meet).select("u", "v").distinct(), [rows, p]


def _digest():
    return F.unhex(F.sha2("text", 256))


def _named_apart(sketched: DataFrame) -> DataFrame:
    """sketched, with one name for each set: of sets that share theirs, those that aren't first by `sure` get another."""
    ends = sketched.groupBy(F.col("node").alias("c_node")).agg(F.min("sure").alias("c_first"), F.max("sure").alias("c_last"))
    clash = written(ends.filter("c_first < c_last").select("c_node", "c_first"), "clashes")
    if not clash.limit(1).count():
        discard(clash)
        return sketched
    again = F.when(F.col("sure") > F.col("c_first"), F.xxhash64("node", "sure")).otherwise(F.col("node"))
    return written(sketched.join(clash, F.col("node") == F.col("c_node"), "left").withColumn("node", again).drop("c_node", "c_first"), "sketches")


def _components(docs: DataFrame, digests: bool = False, size: int = SHINGLE) -> DataFrame:
    """doc_id, n, node, component and root of every row, the last three null for empty sets; digests: and the digest of its text."""
    spark = docs.sparkSession
    calm(spark)
    d = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    extra = (["digest"], ", digest binary") if digests else ([], "")
    rows = d.withColumn("own", F.xxhash64("text"))  # with doc_id it leads back to the text, also where many rows share a doc_id or have none
    rows = rows.withColumn("digest", _digest()) if digests else rows
    sketched = written(rows.mapInArrow(_sketches(size), "doc_id bigint, n bigint, node bigint, sure bigint, bands array<bigint>, own bigint" + extra[1]), "sketches")
    sketched = _named_apart(sketched)
    nodes = written(sketched.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own")).alias("least"), F.first("n").alias("n"), F.first("sure").alias("sure"), F.first("bands").alias("bands")).withColumn("label", F.col("least.doc_id")), "nodes")
    rows = nodes.select(F.explode("bands").alias("key"), "node", "n")
    many = written(rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "many")  # written: then AQE can split hot keys of the join
    shared = written(rows.join(many, "key"), "buckets")
    release(spark)
    mass = shared.groupBy(F.col("node").alias("m_node")).agg(F.sum("c").alias("mass"))
    hubs = shared.join(mass, F.col("node") == F.col("m_node")).groupBy(F.col("key").alias("h_key")).agg(F.max(F.struct("mass", "node", "n")).alias("h"))
    hubs = written(hubs, "hubs")
    stars = shared.join(hubs, F.col("key") == F.col("h_key")).filter((F.col("node") != F.col("h.node")) & _alike(F.col("n"), F.col("h.n")))
    pairs = written(stars.select(F.col("h.node").alias("u"), F.col("node").alias("v")).distinct(), "stars")
    involved = shared.select("node").distinct().join(nodes.select("node", "sure", F.col("label").alias("l_id"), F.col("least.own").alias("l_own")), "node")
    texts = d.join(involved, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.xxhash64("text") == F.col("l_own"))).select("text", "node", "sure")
    members = written(texts.mapInArrow(_set_rows(size), "node bigint, n bigint, s binary").dropDuplicates(["node"]), "sets")
    release(spark)
    links = written(_verified(pairs, members), "links")
    release(spark)
    roots = components(links)
    named = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    open_nodes = written(named.join(split, "key").select("node").distinct(), "open")
    spare = []
    if open_nodes.limit(1).count():
        found, spare = _prefixes(members.join(open_nodes, "node", "left_semi"), roots)
        more = written(_verified(found, members), "links")
        spare.append(more)
        release(spark)
        if more.limit(1).count():
            roots = components(links.unionByName(more))
    labels = nodes.select("node", "label").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = written(labels.groupBy("root").agg(F.min("label").alias("component")), "least")
    discard(many, shared, hubs, pairs, members, links, open_nodes, *spare)
    of_node = labels.join(least, "root").select("node", "component", "root")
    return sketched.select("doc_id", "n", "node", *extra[0]).join(of_node, "node", "left")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, by shingles of `size` words."""
    out = _components(docs, size=size).withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the first by doc_id (null last), then by the digest of its text; further columns as they were."""
    return sheltered(docs, _firsts)


def _firsts(docs: DataFrame) -> DataFrame:
    c = _components(docs, digests=True).filter("root is not null").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("c"))
    c = written(c.withColumn("key", F.struct(F.col("doc_id").isNull(), "doc_id", "digest")), "members")
    first = written(c.groupBy("root").agg(F.min("key").alias("first")), "firsts")
    judged = c.join(first, "root")
    own = lambda rows: rows.select(F.col("doc_id").alias("near_duplicate_id"), F.col("digest").alias("near_duplicate_digest"))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("near_duplicate_id")) & (_digest() == F.col("near_duplicate_digest"))
    gone = written(own(judged.filter("key <> first")), "gone")
    twice = written(own(judged.filter("key = first and c > 1")), "twice")  # rows alike in both
    kept = docs.join(gone.hint("merge"), same, "left_anti")  # as it is for large tables at every size
    if twice.limit(1).count():
        once = kept.join(twice, same).dropDuplicates(["near_duplicate_id", "near_duplicate_digest"]).drop("near_duplicate_id", "near_duplicate_digest")
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    discard(c, first)
    return kept


def query(spark, sf_dir) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), QUERY_SHINGLE)


QUERIES = {"op9_oph_near_dedup": query}
SQL = {
    "op9_oph_near_dedup": r"""
with recursive w as materialized (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w from documents),
s as materialized (select distinct doc_id, least(len(w), 4) k, array_to_string(w[i:i + 3], ' ') g from w, lateral (select unnest(range(1, greatest(len(w) - 3, 1) + 1)) i) where len(w) > 0),
n as materialized (select doc_id, count(*) n from s group by doc_id),
p as materialized (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.k = b.k and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
l as materialized (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 80 * (nx.n + ny.n - c)),
e as materialized (select x, y from l union select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x),
m as (select x, min(y) m from r group by x)
select w.doc_id, coalesce(n.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) component_id, w.doc_id <= coalesce(m, w.doc_id) kept
from w left join n using (doc_id) left join m on m.x = w.doc_id"""
}
