"""Column builders over text: tokens, coverage, intent, paths, languages.

All but token_counts stay in the JVM.  Word classes are ASCII: accented letters part words.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_BLANKS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """F01 with repeats: lower case, runs of a-z and 0-9, over one character."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def _counts(low: pa.Array) -> pa.Array:
    names, times, ends, sizes = [], [], [0], []
    for one in low.cast(pa.binary()).to_pylist():
        found = {t: n for t, n in Counter(one.translate(_BLANKS).split()).items() if len(t) > 1}
        names.append(b" ".join(found))
        times.extend(found.values())
        ends.append(len(times))
        sizes.append(sum(found.values()))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32()))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(names, pa.binary()).cast(pa.string()), lists], ["len", "names", "times"])


def token_counts(text: Column) -> Column:
    """how many tokens(), the distinct ones with blanks between, and how often each: counted within the text, so that no row of a token has to be grouped for
    it, and a text's tokens are one value to write and to move."""
    counts = F.arrow_udf(_counts, "struct<len:int,names:string,times:array<int>>")
    return counts(F.lower(F.coalesce(text, F.lit(""))))


def primary_tokens(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def identifier_tokens(text: Column, distinct: bool = True) -> Column:
    """each identifier whole, without underscores, and in its camel-case and digit parts."""
    raws = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+"), lambda r: F.regexp_replace(r, "^_+|_+$", "")), lambda r: r != "")

    def expand(raw: Column) -> Column:
        low = F.lower(raw)
        cut = raw
        for pattern in ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
            cut = F.regexp_replace(cut, pattern, "$1_$2")
        cut = F.regexp_replace(cut, "([A-Z])([A-Z][a-z])", "$1_$2")
        return F.concat(F.array(low), F.when(low.contains("_"), F.array(F.regexp_replace(low, "_", ""))).otherwise(F.array().cast("array<string>")), F.split(F.lower(cut), "_+"))

    out = F.filter(F.flatten(F.transform(raws, expand)), lambda t: F.length(t) > 1)
    return F.array_distinct(out) if distinct else out


def identifier_bag(text: Column) -> Column:
    """The same tokens, repeats and all, in another order: for whole texts.

    Boundaries are cut in the text as a whole, so no identifier is handled by itself."""
    whole = F.coalesce(text, F.lit(""))
    raws = F.regexp_extract_all(F.lower(whole), F.lit("[a-z0-9](?:[a-z0-9_]*[a-z0-9])"), F.lit(0))
    joined = F.transform(F.filter(raws, lambda r: F.contains(r, F.lit("_"))), lambda r: F.replace(r, F.lit("_"), F.lit("")))
    cut = whole
    for pattern in ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])", "([A-Z])([A-Z][a-z])"):
        cut = F.regexp_replace(cut, pattern, "$1_$2")
    return F.concat(raws, joined, F.regexp_extract_all(F.lower(cut), F.lit("[a-z0-9]{2,}"), F.lit(0)))


def meaningful(token: Column) -> Column:
    return (F.length(token) > 1) & ~token.isin(fixed.STOP_TOKENS) & ~token.rlike("^[0-9]+$")


def drop_low_signal(list_: Column) -> Column:
    """meaningful tokens; all of them if none is."""
    kept = F.array_distinct(F.filter(list_, meaningful))
    return F.when(F.size(kept) > 0, kept).otherwise(list_)


def expand_synonyms(list_: Column) -> Column:
    """each token, then its synonyms, first occurrences only."""
    pairs = [x for head, words in fixed.SYNONYMS.items() for x in (F.lit(head), _words(words.split()))]
    known = F.create_map(*pairs)
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(list_, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(known, t), none)))))


def coverage(query: Column, candidate: Column) -> Column:
    """share of distinct query tokens that the candidate has."""
    q = F.array_distinct(query)
    return F.when((F.size(q) == 0) | (F.size(candidate) == 0), 0.0).otherwise(F.size(F.array_intersect(q, candidate)) / F.size(q))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


# Paths and languages


def normal_path(path: Column) -> Column:
    """forward slashes, without leading ./ and /."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^(\\./)+", ""), "^/+", "")


def path_proximity(current: Column, candidate: Column) -> Column:
    """0.04 for each leading directory that both have, at most 0.20."""
    parts = lambda p: F.split(F.lower(F.translate(p, "\\", "/")), "/")
    a, b = parts(current), parts(candidate)
    dirs = F.least(F.size(a), F.size(b)) - 1
    same = F.transform(F.sequence(F.lit(0), F.greatest(dirs, F.lit(1)) - 1), lambda i: (F.get(a, i) == F.get(b, i)) & (i < dirs))
    lead = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    return F.least(lead * 0.04, F.lit(0.20))


def path_segments(path: Column) -> Column:
    cut = F.array_distinct(F.split(F.lower(normal_path(path)), r"[/\\_.-]+"))
    return F.filter(cut, lambda s: (F.length(s) > 1) & ~s.isin(fixed.GENERIC_SEGMENTS))


def path_token_boost(query: Column, path: Column) -> Column:
    """0.015 for each query token that a telling path segment contains, at most 0.05."""
    segments = path_segments(path)
    hits = F.size(F.filter(query, lambda t: (F.length(t) > 1) & F.exists(segments, lambda s: F.contains(s, F.lower(t)))))
    return F.least(hits * 0.015, F.lit(0.05))


def _mapped(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(value: Column) -> Column:
    """Lower case, no leading dot, no _, -, space; aliases resolved."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"^\.", ""), "[_ -]", "")
    return F.coalesce(_mapped(bare, fixed.LANGUAGE_ALIASES), bare)


def path_language(path: Column) -> Column:
    """Special file names first, then the extension."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.coalesce(_mapped(base, fixed.SPECIAL_FILES), language(F.regexp_extract(base, r"(\.[^.]*)$", 1)))


def language_filter(spec: str) -> set[str] | None:
    """None stands for all."""
    parts = [p.strip() for p in spec.lower().split(",")]
    if parts in ([""], ["all"], ["any"], ["*"]):
        return None
    out: set[str] = set()
    for p in parts:
        bare = p.removeprefix(".").replace("_", "").replace("-", "").replace(" ", "")
        name = fixed.LANGUAGE_ALIASES.get(bare, bare)
        out |= set(fixed.LANGUAGE_GROUPS[name].split()) if name in fixed.LANGUAGE_GROUPS else {name} - {""}
    return out or None


# Topics, intent, structure


def _any_in(list_: Column, values) -> Column:
    return F.arrays_overlap(list_, _words(values))


def is_test_topic(topic: Column) -> Column:
    return topic.rlike(r"_test\.|/test_|/tests/|\.test\.|\.spec\.")


def is_doc_topic(topic: Column) -> Column:
    return topic.endswith(".md") | topic.rlike("readme|contributing|security|changelog")


def is_workflow_topic(topic: Column) -> Column:
    return topic.rlike(r"\.github/workflows/|\.yml|\.yaml")


def topic_penalty(query: Column, topic: Column) -> Column:
    """F16: 0.50 tests, 0.35 documents, 0.08 workflows, unless the query asks for them."""
    t = F.lower(topic)
    part = lambda is_, wants, x: F.when(is_ & ~_any_in(query, wants), x).otherwise(0.0)
    return part(is_test_topic(t), fixed.WANTS_TESTS, 0.50) + part(is_doc_topic(t), fixed.WANTS_DOCS, 0.35) + part(is_workflow_topic(t), fixed.WANTS_WORKFLOWS, 0.08)


def lines_of(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _starts(line: Column, starts) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | line.startswith(s)
    return out


def structure_intent(text: Column) -> Column:
    """class, function or method of the first declaration line; '' without."""
    raw = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"^\s*(class |def |async def )"))
    first = F.get(raw, F.lit(0))
    return F.when(first.isNull(), "").when(first.rlike(r"^\s*class "), "class").when(first.rlike(r"^\s"), "method").otherwise("function")


def has_import_context(text: Column) -> Column:
    return F.exists(lines_of(text), lambda x: _starts(x, fixed.IMPORT_STARTS) | x.contains(" require("))


def query_intent(text: Column) -> Column:
    """one of nine classes, first rule that holds."""
    lines = lines_of(text)
    idents = F.split(F.lower(F.array_join(lines, "\n")), "[^a-z0-9_]+")
    assigned = lambda x: x.rlike("(^|[^=!<>])=([^=>]|$)")
    distinct = F.size(F.array_distinct(F.filter(F.transform(idents, lambda t: F.regexp_replace(t, "_", "")), lambda t: t != "")))
    declared = lambda x: _starts(x, fixed.DECLARATION_STARTS) | x.rlike(r"^@\S*\s+(.*\s)?(public|private|protected|static|final)(\s|$)")
    return (
        F.when(F.size(lines) == 0, "empty")
        .when(F.forall(lines, lambda x: _starts(x, ["#", "//", "*"])), "comment")
        .when(has_import_context(text), "import")
        .when((structure_intent(text) != "") | F.exists(lines, declared), "declaration")
        .when(_any_in(idents, ["except", "catch", "raise", "throw"]), "exception")
        .when(F.exists(lines, assigned), "assignment")
        .when(F.array_join(lines, "\n").rlike(r"(^|[^A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*\s*\("), "call")
        .when(distinct <= 2, "sparse")
        .otherwise("mixed")
    )


def looks_like_code(text: Column) -> Column:
    """A line break, or two or more marks of code."""
    return text.contains("\n") | (F.regexp_count(text, F.lit(fixed.CODE_MARKS)) >= 2)


def negative_word(text: Column) -> Column:
    """the first word of negative feedback, null without."""
    return F.get(F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}_]+"), lambda t: t.isin(fixed.NEGATIVE_WORDS)), F.lit(0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def capped_ratio(a: Column, b: Column) -> Column:
    return F.when(b <= 0, 0.0).otherwise(F.least(a / b, F.lit(1.0)))


def grade(score: Column) -> Column:
    """strong, usable, thin or weak at .75, .55, .35."""
    return F.when(score >= 0.75, "strong").when(score >= 0.55, "usable").when(score >= 0.35, "thin").otherwise("weak")
