"""Secret scans, by DataFrame functions only.

Base rules are regular expressions.  A match's place comes from the text between
matches: split() gives those pieces, regexp_extract_all() the matches, and their
lengths add up to code-point offsets.

Beside them, candidate strings are scanned by entropy.  For each character class
below, a window of fixed length slides over each run of its characters; counts of
the characters in the window, packed into a few numbers, and the sum of c * log2(c)
are kept up step by step, so a step costs the same wherever it is.  Windows at or over the class's bits are
joined to spans.  Runs on the allow-list (placeholders, plain words, paths, ids
that are no secrets) give none, nor do spans within a base span.

Cases: text null counts as empty; repeated rows are each scanned; spans that begin
together are in the order of RULES, then CLASSES; a text that is one long candidate
is scanned whole; further columns are left.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, sheltered, table

#: Fixed patterns: kind, pattern, group that is measured, its least length.
RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Class, its runs, window in characters, bits an average character of a window must carry.
CLASSES = [
    ("entropy_hex", r"[0-9A-Fa-f]{24,}", 24, 3.01),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.76),
]
#: Runs that match any of these are let be.  No group is repeated without bound here: the pattern engine recurses once a repetition.
ALLOW = [
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|lorem|localhost|your[_-]",
    r"(?i)0123456789|abcdefghij|(.)\1{7}",
    r"^[^0-9]+$",
    r"^[0-9/_=+-]+$",
    r"(?i)^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$",
    r"^[A-Za-z_/-]*/[A-Za-z0-9_-]{0,19}$",
]
MASK = "[SECRET]"
_SPAN = "array<struct<start:int,rank:int,end:int>>"
#: Counts of a window's characters are packed, BITS each, SLOTS to a 64-bit number.
BITS, SLOTS = 5, 12
#: Code points of a text's blocks, in which places are looked up.
BLOCK = 4096


def _none(kind: str = _SPAN) -> Column:
    return F.array().cast(kind)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(rows: Column, kind: str, measure, join) -> Column:
    """array<struct<row, before>>: what `join` (+ or greatest) makes of the measures of all rows before each.

    In blocks of the square root of the number of rows, as appending to an array copies it."""
    out = f"array<struct<row:{kind},before:int>>"
    zero = lambda t: F.struct(F.lit(0).alias("total"), _none(t).alias("out"))

    def one(acc: Column, x: Column) -> Column:
        return F.struct(join(acc["total"], measure(x)).alias("total"), F.concat(acc["out"], F.array(F.struct(x.alias("row"), acc["total"].alias("before")))).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda y: F.struct(y["row"].alias("row"), join(acc["total"], y["before"]).alias("before")))
        return F.struct(join(acc["total"], b["total"]).alias("total"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def run(all_: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")), lambda k: F.aggregate(F.slice(all_, k * size + 1, size), zero(out), one))
        return F.when(F.size(all_) > 0, F.flatten(F.aggregate(blocks, zero(f"array<{out}>"), block, lambda acc: acc["out"]))).otherwise(_none(out))

    return _let(rows, run)


def _add(a: Column, b: Column) -> Column:
    return a + b


def _hits(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, hit>> of matches whose group has `least` characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), measured.alias("part"))
    placed = _running(rows, "struct<gap:string,hit:string,part:string>", lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)), _add)
    kept = F.filter(placed, lambda y: F.length(y["row"]["part"]) >= least)  # the last row has a gap only
    begin = lambda y: y["before"] + F.length(y["row"]["gap"])
    found = F.transform(kept, lambda y: F.struct(begin(y).alias("start"), (begin(y) + F.length(y["row"]["hit"])).alias("end"), y["row"]["hit"].alias("hit")))
    return F.when(text.rlike(pattern), found).otherwise(_none("array<struct<start:int,end:int,hit:string>>"))


def _places(text: Column, pattern: str, rank: int, group: int, least: int) -> Column:
    return F.transform(_hits(text, pattern, group, least), lambda h: F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end")))


def _windows(run: Column, offset: Column, rank: int, width: int, bits: float, chars: str) -> Column:
    """Joined windows of one run, of these characters, that carry enough bits, as spans of the text."""
    slot = {ord(c): k for k, c in enumerate(chars)}
    words = -(-len(chars) // SLOTS)
    by_code = lambda f: F.array(*[F.lit(f(slot[c]) if c in slot else 0) for c in range(128)])
    word, shift = by_code(lambda k: k // SLOTS), by_code(lambda k: k % SLOTS * BITS)
    weigh = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(width + 2)])
    most = (math.log2(width) - bits) * width  # of the sum of c * log2(c)
    counts = F.array_repeat(F.lit(0).cast("bigint"), words)
    begin = F.struct(counts.alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), _none().alias("out"))
    f = lambda c: F.element_at(weigh, c + 1)
    one = lambda acc: F.array(F.struct((offset + acc["a"]).alias("start"), F.lit(rank).alias("rank"), (offset + acc["b"]).alias("end")))

    def count(n: Column, code: Column) -> Column:
        """Of this character: a shift and a mask."""
        return F.call_function("shiftright", F.get(n, F.get(word, code)), F.get(shift, code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def unit(code: Column, k: Column) -> Column:
        return F.when(F.get(word, code) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.get(shift, code))).otherwise(F.lit(0).cast("bigint"))

    def step(acc: Column, x: Column) -> Column:
        code, gone = x["code"], x["gone"]
        up = count(acc["n"], code)
        down = F.when(gone >= 0, count(acc["n"], gone) + (gone == code).cast("int")).otherwise(F.lit(0))
        s = acc["s"] + _let(up, lambda u: f(u + 1) - f(u)) + _let(down, lambda d: F.when(d > 0, f(d - 1) - f(d)).otherwise(F.lit(0.0)))
        n = F.transform(acc["n"], lambda c, k: c + unit(code, k) - F.when(gone >= 0, unit(gone, k)).otherwise(F.lit(0).cast("bigint")))
        return _let(s, lambda bound: after(acc, n, bound))

    def after(acc: Column, n: Column, s: Column) -> Column:
        i = acc["i"]
        hit = (i >= width - 1) & (s <= most)
        first = i - (width - 1)
        apart = hit & (acc["b"] >= 0) & (first > acc["b"])
        return F.struct(
            n.alias("n"), s.alias("s"), (i + 1).alias("i"),
            F.when(hit & (apart | (acc["b"] < 0)), first).otherwise(acc["a"]).alias("a"),
            F.when(hit, i + 1).otherwise(acc["b"]).alias("b"),
            F.when(apart, F.concat(acc["out"], one(acc))).otherwise(acc["out"]).alias("out"),
        )

    def slide(codes: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(-1), width), F.slice(codes, 1, F.size(codes) - width))
        rows = F.arrays_zip(codes.alias("code"), leaving.alias("gone"))
        return F.aggregate(rows, begin, step, lambda acc: F.when(acc["b"] >= 0, F.concat(acc["out"], one(acc))).otherwise(acc["out"]))

    return _let(F.transform(F.split(run, ""), lambda c: F.ascii(c)), slide)


def _scanner(rank: int, width: int, bits: float, chars: str):
    def of_run(r: Column) -> Column:
        allowed = F.lit(False)
        for a in ALLOW:
            allowed = allowed | r["hit"].rlike(a)
        return F.when(allowed, _none()).otherwise(_windows(r["hit"], r["start"], rank, width, bits, chars))

    return of_run


def scan(docs: DataFrame) -> DataFrame:
    """docs with `base` and `spans`: array<struct<start, rank, end>>, code points, end exclusive; rank numbers RULES, then CLASSES.

    What docs has under these names is replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.drop("base", "spans")
    found = [_places(text, p, k, group, least) for k, (_, p, group, least) in enumerate(RULES)]
    out = kept.withColumn("base", F.array_sort(F.concat(*found)))
    extra = []
    for k, (_, pattern, width, bits) in enumerate(CLASSES, len(RULES)):
        chars = "".join(c for c in map(chr, range(128)) if re.match(pattern.partition("{")[0], c))
        runs = _hits(text, pattern, 0, width)
        extra.append(F.when(text.rlike(pattern), F.flatten(F.transform(runs, _scanner(k, width, bits, chars)))).otherwise(_none()))
    ranked = F.array_sort(F.concat("base", *extra))  # of spans that begin together the base ones come first
    reach = _running(ranked, "struct<start:int,rank:int,end:int>", lambda x: F.when(x["rank"] < len(RULES), x["end"]).otherwise(F.lit(0)), F.greatest)
    own = F.filter(reach, lambda y: (y["row"]["rank"] < len(RULES)) | (y["before"] < y["row"]["end"]))
    return out.withColumn("spans", F.transform(own, lambda y: y["row"]))


def _written(spans: str) -> Column:
    names = F.array(*[F.lit(k[0]) for k in [*RULES, *CLASSES]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    many = lambda k: F.size(F.filter("base", lambda b: b["rank"] == k)).cast("bigint")
    return scanned.select("doc_id", *[many(k).alias(f"n_{kind[0]}") for k, kind in enumerate(RULES)], F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with the spans of secrets masked in text, and n_chars, if there is one, counted anew; other rows are as they were."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = scan(docs)

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b, from the blocks they lie in."""
        parts = F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int"))
        part = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * BLOCK, F.lit(0)) + 1, b - F.greatest(a, k * BLOCK))
        return F.when(b > a, F.array_join(F.transform(parts, part), "")).otherwise(F.lit(""))

    def mask_all(blocks: Column) -> Column:
        reach = _running(F.col("spans"), "struct<start:int,rank:int,end:int>", lambda x: x["end"], F.greatest)
        fresh = F.filter(reach, lambda y: y["row"]["start"] >= y["before"])
        parts = F.transform(fresh, lambda y: F.concat(between(blocks, y["before"], y["row"]["start"]), F.lit(mask)))
        last = F.array_max(F.transform("spans", lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), between(blocks, last, F.length(text)))

    masked = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), mask_all)
    out = scanned.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; further columns as they were.

    text null stays null, empty stays empty; repeated rows are each masked; of spans that overlap one mask is left."""
    return sheltered(docs, redact)


def query(spark, sf_dir) -> DataFrame:
    return digest(scan(pick(table(spark, sf_dir, "documents"), "doc_id", "text")))


QUERIES = {"op6_secret_scan": query}


def _sql() -> str:
    """The same in DuckDB, whose patterns have no back-references: eight equal characters are looked for one by one."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    base = " union all ".join(f"select doc_id, {k} r, {least} least, regexp_split_to_array(t, {q(p)}) gaps, regexp_extract_all(t, {q(p)}) hits, regexp_extract_all(t, {q(p)}, {g}) parts from d where regexp_matches(t, {q(p)})" for k, (_, p, g, least) in enumerate(RULES))
    own = " union all ".join(f"select doc_id, {k} r, {w} least, regexp_split_to_array(t, {q(p)}) gaps, regexp_extract_all(t, {q(p)}) hits, regexp_extract_all(t, {q(p)}) parts from d where regexp_matches(t, {q(p)})" for k, (_, p, w, _) in enumerate(CLASSES, len(RULES)))
    place = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    plain = [a for a in ALLOW if "\\1" not in a]
    same = "len(list_filter(range(1, length(run) - 6), lambda j: substr(run, j, 8) = repeat(substr(run, j, 1), 8))) > 0"
    allowed = " or ".join([*(f"regexp_matches(run, {q(a)})" for a in plain), "regexp_matches(run, '(?i)0123456789|abcdefghij')", same])
    width = "case r " + " ".join(f"when {k} then {w}" for k, (_, _, w, _) in enumerate(CLASSES, len(RULES))) + " end"
    bits = "case r " + " ".join(f"when {k} then {b}" for k, (_, _, _, b) in enumerate(CLASSES, len(RULES))) + " end"
    kinds = "[" + ", ".join(q(k[0]) for k in [*RULES, *CLASSES]) + "]"
    return f"""
with d as (select doc_id, coalesce(text, '') t from documents),
b as materialized (select doc_id, r, s::bigint s, (s + length(h))::bigint e from (select doc_id, r, {place} s, hits[i] h from ({base}), lateral (select unnest(range(1, len(hits) + 1)) i) where length(parts[i]) >= least)),
u as materialized (select doc_id, r, {place} s, hits[i] run, {width} w, {bits} bits from ({own}), lateral (select unnest(range(1, len(hits) + 1)) i)),
k as (select doc_id, r, s, w, j from (select *, unnest(range(0, (length(run) - w + 1)::bigint)) j from u where not ({allowed})) where list_aggregate(string_split(substr(run, (j + 1)::bigint, w), ''), 'entropy') >= bits),
g as (select *, sum(fresh) over (partition by doc_id, r, s order by j) island from (select *, case when j > lag(j) over (partition by doc_id, r, s order by j) + w or lag(j) over (partition by doc_id, r, s order by j) is null then 1 else 0 end fresh from k)),
o as (select doc_id, r, (s + min(j))::bigint a, (s + max(j) + any_value(w))::bigint e from g group by doc_id, r, s, island),
x as (select doc_id, r, s, e from b union all select doc_id, r, a, e from o where not exists (select 1 from b where b.doc_id = o.doc_id and b.s <= o.a and o.e <= b.e)),
f as (select doc_id, count(*) filter (r = 0) n0, count(*) filter (r = 1) n1, count(*) filter (r = 2) n2, string_agg({kinds}[r + 1] || ':' || s || ':' || e, ',' order by s, r, e) filter (r < {len(RULES)}) base, string_agg({kinds}[r + 1] || ':' || s || ':' || e, ',' order by s, r, e) spans from x group by doc_id)
select doc_id, coalesce(n0, 0) n_assign, coalesce(n1, 0) n_access, coalesce(n2, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join f using (doc_id)"""


SQL = {"op6_secret_scan": _sql()}
