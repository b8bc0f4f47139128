"""A Merkle manifest of a dataset: a tree for each group, and a tree over their roots.

Leaves are put in order by a range shuffle and kept in units, runs of at most UNIT
leaves of one group.  Sizes of units give every leaf its index, and a group's size gives
the shape of its tree: how many children a node has follows from its level and index.

Nodes come about by events.  A child's digest arrives at its parent, which keeps it by
its place; once the parent has as many as its size says, it becomes a digest itself, which
is an event for the parent above.  Each unit runs this on its own, which leaves parents
at its two ends that still wait for children from elsewhere: its frontier.  Frontiers
are dealt by the subtree of height BLOCK that they lie in, where the parts of a
parent meet and events go on; what still waits is dealt by subtrees WIDER levels higher,
and so on.  So a task gets the two edges of some hundred units, or a few hundred roots of
subtrees, however large a group is.

Proofs come by links the other way: each unit notes the nodes above it that it couldn't
finish itself, and is sent their children.  With its own nodes it then has the siblings
on the way up of each of its leaves.  A group's top is asked for by each of its units (a
row for UNIT documents), in a join that adaptive execution splits.

Cases: null in any column is hashed as null, apart from an empty text; source null is a group, and comes first; doc_id
null comes before all others of its source; rows that share a doc_id are ordered by
their digest, and repeated rows are a leaf each; a group of one leaf has that leaf as its
root; an empty table gives no row; further columns are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, table, written

ARITY, UNIT, BLOCK, WIDER = 3, 4096, 12, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "unit bigint, grp string, total bigint, level int, idx bigint, kids array<string>, digest string, root boolean"
_PART = 24  # bits of a unit's number that count within a part


def digest_of(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """Hex digest of values, each as `-` or its length in UTF-8 bytes, `:` and itself."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]), 256)


def height(total: int) -> int:
    """Level of the root over so many leaves."""
    h = 0
    while total > 1:
        total, h = -(-total // ARITY), h + 1
    return h


class Parents:
    """Nodes of one group's tree that wait for children."""

    def __init__(self, total: int):
        self.widths = [total]
        while self.widths[-1] > 1:
            self.widths.append(-(-self.widths[-1] // ARITY))
        self.top, self.waiting = len(self.widths) - 1, {}

    def arity(self, level: int, idx: int) -> int:
        return min(ARITY, self.widths[level - 1] - ARITY * idx)

    def child(self, level: int, idx: int, digest: str) -> Iterator[tuple[int, int, list[str], str]]:
        """A node's digest arrives at its parent: (level, idx, children, digest) of all that this finishes, upwards."""
        if level < self.top:
            yield from self.children(level + 1, idx // ARITY, {idx % ARITY: digest})

    def children(self, level: int, idx: int, some: dict[int, str]) -> Iterator[tuple[int, int, list[str], str]]:
        """Children of a node arrive, by place."""
        while True:
            have = self.waiting.setdefault((level, idx), {})
            have.update(some)
            if len(have) < self.arity(level, idx):
                return
            kids = [have[k] for k in range(len(have))]
            del self.waiting[level, idx]
            digest = digest_of(kids)
            yield level, idx, kids, digest
            if level == self.top:
                return
            level, idx, some = level + 1, idx // ARITY, {idx % ARITY: digest}


def units(leaves: DataFrame) -> DataFrame:
    """leaves (grp, id, digest, claim: both binary) in order, as a table with a row per unit: unit, grp, n, ids, digests, claims."""
    kind = leaves.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << _PART
        grp, n, parts = None, 0, []

        def flush() -> pa.RecordBatch:
            ids = pa.concat_arrays([p.column(1) for p in parts])
            blobs = [b"".join(x for p in parts for x in p.column(c).to_pylist()) for c in (2, 3)]
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([grp], pa.string()), pa.array([n], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in blobs)],
                ["unit", "grp", "n", "ids", "digests", "claims"],
            )

        for b in batches:
            names, at = b.column(0).to_pylist(), 0
            while at < len(names):
                if n and (names[at] != grp or n == UNIT):
                    yield flush()
                    number, n, parts = number + 1, 0, []
                grp, end = names[at], at
                while end < len(names) and names[end] == grp and end - at < UNIT - n:
                    end += 1
                parts.append(b.slice(at, end - at))
                n, at = n + end - at, end
        if n:
            yield flush()

    order = ["grp", "id", "digest", "claim", "salt"]  # salt: a row's number, so that repeated rows part too
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_ = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(sorted_.select("grp", "id", "digest", "claim").mapInArrow(run, f"unit bigint, grp string, n int, ids array<{kind}>, digests binary, claims binary"), "units")


def bases(of: DataFrame) -> DataFrame:
    """unit, grp, base (index of its first leaf), total (leaves of the group), as a table.

    First over the parts of a group, then over the units of a part."""
    narrow = of.select("unit", "grp", "n", F.shiftright("unit", _PART).alias("part"))
    parts = narrow.groupBy("grp", "part").agg(F.sum("n").alias("n_part"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("p_base", F.coalesce(F.sum("n_part").over(before(Window.partitionBy("grp").orderBy("part"))), F.lit(0))).withColumn("total", F.sum("n_part").over(Window.partitionBy("grp")))
    inner = F.coalesce(F.sum("n").over(before(Window.partitionBy("grp", "part").orderBy("unit"))), F.lit(0))
    return written(narrow.withColumn("inner", inner).join(parts, ["grp", "part"]).select("unit", "grp", (F.col("p_base") + F.col("inner")).alias("base"), "total"), "unit-bases")


def _hexes(blob: bytes) -> list[str]:
    text = blob.hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def _batches(rows: Iterator[tuple], most: int = 2000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("unit", pa.int64()), ("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("kids", pa.list_(pa.string())), ("digest", pa.string()), ("root", pa.bool_())])
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for r in rows:
        held.append(r)
        if len(held) == most:
            yield flush()
            held = []
    if held:
        yield flush()


def risen(of: DataFrame, at: DataFrame) -> DataFrame:
    """What units make of their leaves, as a table of nodes: those that wait (kids by place, digest null), links to the nodes above these (kids
    null), and roots of groups that lie in one unit."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for unit, grp, base, total, blob in zip(*(c.to_pylist() for c in b.columns)):
                tree, root = Parents(total), None
                for k, d in enumerate(_hexes(blob), base):
                    root = d if total == 1 else None
                    for level, _, _, digest in tree.child(0, k, d):
                        root = digest if level == tree.top else None
                if root:
                    yield unit, grp, total, tree.top, 0, None, root, True
                above = set()
                for (level, idx), have in tree.waiting.items():
                    yield unit, grp, total, level, idx, [have.get(k) for k in range(ARITY)], None, False
                    above |= {(level + k, idx // ARITY**k) for k in range(1, tree.top - level + 1)}
                for level, idx in sorted(above - set(tree.waiting)):
                    yield unit, grp, total, level, idx, None, None, False

    d = of.select("unit", "digests").join(at, "unit").select("unit", "grp", "base", "total", "digests")
    return written(d.mapInArrow(lambda batches: _batches(rows(batches)), _NODES), "nodes")


def resolved(frontier: DataFrame, level: int) -> DataFrame:
    """The frontier's parts of each subtree of this height put together: nodes finished (digest) and nodes that still wait, as a table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trees: dict[str, Parents] = {}
        for b in batches:
            for _, grp, total, at, idx, kids, _, _ in zip(*(c.to_pylist() for c in b.columns)):
                tree = trees.get(grp) or trees.setdefault(grp, Parents(total))
                for up, i, full, digest in tree.children(at, idx, {k: x for k, x in enumerate(kids) if x is not None}):
                    yield None, grp, total, up, i, full, digest, up == tree.top
        for grp, tree in trees.items():
            for (at, idx), have in tree.waiting.items():
                yield None, grp, tree.widths[0], at, idx, [have.get(k) for k in range(ARITY)], None, False

    powers = F.array(*[F.lit(ARITY**k) for k in range(level + 1)])
    block = F.when(F.col("level") <= level, F.floor(F.col("idx") / F.get(powers, F.lit(level) - F.col("level")))).otherwise(F.col("idx"))
    dealt = frontier.repartition("grp", F.greatest("level", F.lit(level)), block)
    return written(dealt.mapInArrow(lambda batches: _batches(rows(batches)), _NODES), "nodes")


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(units, their bases, links of units to nodes, nodes finished after the units, roots: grp, digest)."""
    of = units(leaves)
    at = bases(of)
    first = risen(of, at)
    most = at.agg(F.max("total")).head()[0] or 1  # one number
    waits = first.filter(F.col("kids").isNotNull())
    nodes, level = None, BLOCK
    while True:
        after = resolved(waits, level)
        done = after.filter(F.col("digest").isNotNull())
        nodes = done if nodes is None else nodes.unionByName(done)
        if level >= height(most):
            break
        waits, level = after.filter(F.col("digest").isNull()), level + WIDER
    roots = first.filter("root").unionByName(nodes.filter("root")).select("grp", "digest")
    return of, at, first.filter(~F.col("root")).select("unit", "grp", "level", "idx"), nodes, roots


_PROOF = "array<struct<before:string,after:string>>"


def paths(of: DataFrame, at: DataFrame, links: DataFrame, nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """grp, id, digest, claim, subroot, root, proof: of every leaf the siblings before and after it, level by level; tops: grp, subroot, root,
    proof (of the group's root on to `root`)."""
    kind = of.schema["ids"].dataType.elementType.simpleString()
    sent = links.join(nodes.select("grp", "level", "idx", "kids"), ["grp", "level", "idx"]).groupBy("unit").agg(F.collect_list(F.struct("level", "idx", "kids")).alias("sent"))  # two a level at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                grp, base, total, digests, claims, subroot, root, on, sent = (b.column(k)[r].as_py() for k in (0, 1, 2, 4, 5, 6, 7, 8, 9))
                tree, leaves = Parents(total), _hexes(digests)
                kids = {(x["level"], x["idx"]): x["kids"] for x in sent or []}
                for k, d in enumerate(leaves, base):
                    kids |= {(level, idx): full for level, idx, full, _ in tree.child(0, k, d)}
                known = {(tree.top, 0): ([x["before"] for x in on], [x["after"] for x in on])}

                def path(level: int, idx: int, tree=tree, kids=kids, known=known) -> tuple[list[str], list[str]]:
                    if (level, idx) not in known:
                        run, spot = kids[level + 1, idx // ARITY], idx % ARITY
                        before, after = path(level + 1, idx // ARITY)
                        known[level, idx] = ["".join(run[:spot]), *before], ["".join(run[spot + 1 :]), *after]
                    return known[level, idx]

                ids, claimed = b.column(3)[r].values, _hexes(claims)
                for lo in range(0, len(leaves), 256):
                    hi = min(len(leaves), lo + 256)
                    own = [path(0, base + k) for k in range(lo, hi)]
                    sides = [pa.array([x for p in own for x in p[side]], pa.string()) for side in (0, 1)]
                    offsets = [0]
                    for p in own:
                        offsets.append(offsets[-1] + len(p[0]))
                    proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(sides, ["before", "after"]))
                    same = lambda x, n=hi - lo: pa.array([x] * n, pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [same(grp), ids.slice(lo, hi - lo), pa.array(leaves[lo:hi]), pa.array(claimed[lo:hi]), same(subroot), same(root), proof], ["grp", "id", "digest", "claim", "subroot", "root", "proof"]
                    )

    narrow = at.join(tops, "grp").join(sent, "unit", "left").withColumnRenamed("unit", "a_unit").drop("n")
    d = of.select("unit", "ids", "digests", "claims").join(narrow, F.col("unit") == F.col("a_unit"))
    d = d.select("grp", "base", "total", "ids", "digests", "claims", "subroot", "root", "proof", "sent")
    return d.mapInArrow(run, f"grp string, id {kind}, digest string, claim string, subroot string, root string, proof {_PROOF}")


def manifest(rows: DataFrame, group: Column, key: Column, digest: Column, claim: Column | None = None) -> DataFrame:
    """id, digest, claim, subroot, root, proof of every row: a tree for each group, leaves in order of their key, and one over the groups' roots.

    digest, claim: hex; claim is what a holder of the row shows now, carried along so that it can be checked."""
    leaves = rows.select(F.coalesce(F.concat(F.lit("s"), group.cast("string")), F.lit("-")).alias("grp"), key.alias("id"), F.unhex(digest).alias("digest"), F.unhex(digest if claim is None else claim).alias("claim"))
    own = forest(leaves)
    roots = written(own[4], "subroots")
    over = forest(roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.unhex("digest").alias("digest"), F.unhex("digest").alias("claim")))
    top = over[4].select("grp", F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.array().cast(_PROOF).alias("proof"))
    tops = paths(*over[:4], top).select(F.col("id").alias("grp"), F.col("digest").alias("subroot"), "root", "proof")
    return paths(*own[:4], written(tops, "group-proofs")).drop("grp")


def proof_digest(proof: Column) -> Column:
    """Hex digest of all siblings of a proof, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(claim: Column, proof: Column) -> Column:
    """The root that a digest and a proof lead to."""
    return F.aggregate(proof, claim, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def query(spark, sf_dir) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), *COLUMNS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    seen = manifest(docs, F.col("source"), F.col("doc_id").cast("bigint"), leaf(*map(F.col, COLUMNS)), leaf(*map(F.col, COLUMNS[:-1]), tampered))
    out = seen.withColumn("folded_root", folded(F.col("claim"), F.col("proof")))
    return out.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op13_merkle_manifest": query}


def _sql() -> str:
    enc = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end"
    leaf_ = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = "list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: case when xor(a, x) % 2 = 1 then xor(xor(a, x) // 2, 3988292384) else xor(a, x) // 2 end)"
    rise = lambda name, keys: f"select {keys}, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' order by idx)) from {name} where n > 1 group by {keys}, level, idx // 3, n"
    climb = lambda name, keys, match: f"select {keys}, f.level + 1, f.idx // 3, (f.n + 2) // 3, p || array_to_string(k.hs[1:f.idx % 3], '') || array_to_string(k.hs[f.idx % 3 + 2:], ''), sha256(array_to_string(k.hs[1:f.idx % 3], '') || f.h || array_to_string(k.hs[f.idx % 3 + 2:], '')) from {name} f join k{name} k on {match} k.level = f.level and k.parent = f.idx // 3 where f.n > 1"
    return f"""
with recursive
e as materialized (select row_number() over () r, doc_id, source, {leaf_("text")} leaf, {leaf_("(case when xor(" + crc + ", 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end)")} claim from documents),
b as materialized (select *, row_number() over (partition by source order by doc_id nulls first, leaf, claim) - 1 idx, count(*) over (partition by source) n from e),
t(source, level, idx, n, h) as (select source, 0, idx, n, leaf from b union all {rise("t", "source")}),
sub as materialized (select source, h subroot, row_number() over (order by source nulls first) - 1 idx, count(*) over () n from t where n = 1),
u(g, level, idx, n, h) as (select 0, 0, idx, n, subroot from sub union all {rise("u", "g")}),
kf as materialized (select source, level, idx // 3 parent, list(h order by idx) hs from t where n > 1 group by source, level, idx // 3),
kv as materialized (select level, idx // 3 parent, list(h order by idx) hs from u where n > 1 group by level, idx // 3),
f(r, source, level, idx, n, p, h) as (select r, source, 0, idx, n, '', claim from b union all {climb("f", "f.r, f.source", "k.source is not distinct from f.source and")}),
v(r, level, idx, n, p, h) as (select f.r, 0, sub.idx, sub.n, f.p, f.h from f join sub on f.source is not distinct from sub.source where f.n = 1 union all {climb("v", "f.r", "")})
select doc_id, leaf, subroot, u.h root, sha256(v.p) proof_sha256, v.h folded_root, v.h = u.h verified
from b join sub on b.source is not distinct from sub.source join v on v.r = b.r and v.n = 1 join u on u.n = 1"""


SQL = {"op13_merkle_manifest": _sql()}
