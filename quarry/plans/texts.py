"""Token, path, language and table queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import store
from .retrieval import read, toks


def _tokens(spark, sf, make):
    d = read(spark, sf, "documents").select("doc_id", make(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("tokens_sha256"))


def primary_tokens(spark, sf):
    return _tokens(spark, sf, text.primary_tokens)


def identifier_tokens(spark, sf):
    return _tokens(spark, sf, lambda t: F.array_distinct(text.identifier_bag(t)))


def identifier_tokens_names(spark, sf):
    """Over names with digits and marks, where identifiers part."""
    p = read(spark, sf, "part").select(F.concat_ws("_", "p_name", "p_brand", "p_type").alias("name"))
    c = read(spark, sf, "customer").select(F.concat("c_mktsegment", F.lit("X"), "c_name").alias("name"))
    names = p.union(c).distinct()
    return names.select("name", F.array_join(F.array_sort(text.identifier_tokens(F.col("name"))), " ").alias("tokens"))


def stop_filter(spark, sf):
    return _tokens(spark, sf, lambda t: text.drop_low_signal(text.primary_tokens(t)))


def synonym_expand(spark, sf):
    """Over order priorities and statuses joined with action words, so that heads occur."""
    o = read(spark, sf, "orders").select(F.concat_ws(" ", F.lit("delete"), "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "close").otherwise("fetch error")).alias("prompt")).distinct()
    return o.select("prompt", F.array_join(F.array_sort(text.expand_synonyms(text.primary_tokens(F.col("prompt")))), " ").alias("tokens"))


def query_intent(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "text")
    return c.select("conv_id", "turn", text.query_intent(F.col("text")).alias("intent"), text.looks_like_code(F.col("text")).alias("code"))


def structure_intent(spark, sf):
    """Over prompts made of names, as documents hold no code."""
    p = read(spark, sf, "part").withColumn("prompt", F.expr("case p_partkey % 4 when 0 then concat('class ', p_brand, ':') when 1 then concat('  def ', p_brand, '(x):') when 2 then concat('# note\nasync def ', p_brand, '(x)') else p_name end"))
    return p.select("p_partkey", text.structure_intent(F.col("prompt")).alias("structure"), text.query_intent(F.col("prompt")).alias("intent"))


_TOPIC = "case p_partkey % 5 when 0 then concat('src/', p_brand, '_test.go') when 1 then concat('docs/', p_brand, '.md') when 2 then concat('.github/workflows/', p_brand, '.yml') when 3 then concat('pkg/tests/', p_brand, '.py') else concat('src/', p_brand, '.py') end"
_ASK = "case p_size % 3 when 0 then 'run tests' when 1 then 'install docs' else 'release cache' end"


def topic_penalty(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.expr(_TOPIC).alias("topic"), F.expr(_ASK).alias("ask"))
    return p.select("p_partkey", F.round(text.topic_penalty(text.primary_tokens(F.col("ask")), F.col("topic")), 6).alias("penalty"))


def path_token_boost(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.expr(_TOPIC).alias("topic"), F.concat_ws(" ", F.expr(_ASK), "p_brand").alias("ask"))
    return p.select("p_partkey", F.round(text.path_token_boost(text.primary_tokens(F.col("ask")), F.col("topic")), 6).alias("boost"))


def _url_path(c="url"):
    return F.regexp_replace(F.regexp_replace(c, "^[a-z]+://", ""), "[?#].*$", "")


def path_proximity(spark, sf):
    """Each page against the one before it, by page_id, of its host."""
    p = read(spark, sf, "pages").select("page_id", _url_path().alias("path"))
    p = p.withColumn("host", F.split_part("path", F.lit("/"), F.lit(1)))
    q = p.withColumn("before", F.lag("path").over(Window.partitionBy("host").orderBy("page_id"))).filter("before is not null")
    return q.select("page_id", F.round(text.path_proximity(F.col("before"), F.col("path")), 6).alias("boost"))


def path_normalise(spark, sf):
    p = read(spark, sf, "pages").select("page_id", F.concat(F.lit("./"), F.translate(_url_path(), "/", "\\")).alias("raw"))
    return p.select("page_id", text.normal_path(F.col("raw")).alias("path"))


def language_from_path(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.expr("case p_partkey % 6 when 0 then 'a/Makefile' when 1 then 'b/Dockerfile' when 2 then 'x.PY' when 3 then 'lib/y.yml' when 4 then concat('z/', p_brand) else 'q/v.Markdown' end").alias("path"))
    return p.select("p_partkey", text.path_language(F.col("path")).alias("language"))


def language_normalise(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.expr("case p_partkey % 6 when 0 then ' .Java_Script' when 1 then 'C#' when 2 then 'Objective-C' when 3 then 'Type Script React' when 4 then p_brand else 'GoLang' end").alias("raw"))
    return p.select("p_partkey", text.language(F.col("raw")).alias("language"))


def language_filter(spark, sf):
    """Languages of a group and a single one."""
    wanted = sorted(text.language_filter("systems, python"))
    p = read(spark, sf, "part").select("p_partkey", F.expr("element_at(array('go','py','js','rs','zig','md','c'), cast(p_partkey % 7 as int) + 1)").alias("language"))
    return p.filter(F.col("language").isin(wanted)).groupBy("language").agg(F.count("*").alias("n"))


def language_stats(spark, sf):
    return store.language_counts(read(spark, sf, "documents").withColumnRenamed("lang", "language"))


def keep_latest(spark, sf):
    """The last event of each user and type."""
    e = read(spark, sf, "events")
    return store.latest(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


def size_filter(spark, sf):
    """By bytes of UTF-8, not characters."""
    d = read(spark, sf, "documents").withColumn("bytes", F.octet_length("text").cast("bigint"))
    return d.filter("bytes <= 2048").groupBy("lang").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def ignore_match(spark, sf):
    """Directory suffix, bare name, path prefix, glob, over source/lang/id paths."""
    d = read(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return d.withColumn("ignored", store.ignored(F.col("path"), ["en/", "src1", "src2/de", "src?5/*"])).select("doc_id", "ignored")


def line_windows(spark, sf):
    """Windows of 8 lines, 2 of them shared with the one before: the line form of the chunker."""
    d = read(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("lines") - 2, F.lit(1)), F.lit(6))
    w = d.select("doc_id", "lines", F.posexplode(starts).alias("seq", "start_line"))
    chunk = F.slice("lines", F.col("start_line"), F.lit(8))
    return w.select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.col("start_line").cast("bigint").alias("start_line"), (F.col("start_line") + F.size(chunk) - 1).cast("bigint").alias("end_line"), F.sha2(F.array_join(chunk, "\n"), 256).alias("content_hash"))


def declaration_lines(spark, sf):
    """Lines that look like declarations, per document."""
    d = read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.filter(F.col("line").rlike(r"^\s*(class|def|func|function|type|public|private)\s")).groupBy("doc_id").agg(F.count("*").alias("n"))


def negative_feedback(spark, sf):
    """Newest first; the table holds none of the words, so its rows are those of prompts with one put in."""
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 10 == 0, F.concat("text", F.lit(" This is WRONG, useless."))).otherwise(F.col("text")).alias("said"))
    return c.withColumn("sentiment", text.negative_word(F.col("said"))).filter("sentiment is not null").select("conv_id", "turn", "sentiment")


def secret_assignments(spark, sf):
    """Every offending document."""
    return read(spark, sf, "documents").filter(F.col("text").rlike(fixed.SECRET_ASSIGNMENT)).select("doc_id", "source")


def content_hash_dedupe(spark, sf):
    """Of equal contents the least doc_id, and how many there are."""
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _versions(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    old = d.filter("path % 11 <> 0").select("path", F.sha2("text", 256).alias("content_hash"))
    new = d.filter("path % 7 <> 0").select("path", F.sha2(F.when(F.col("path") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return old, new


def snapshot_diff(spark, sf):
    """New, changed, deleted, same."""
    old, new = _versions(spark, sf)
    return store.snapshot_diff(old, new, "path", "content_hash").groupBy("status").agg(F.count("*").alias("n"), F.sum("path").alias("paths"))


def snapshot_merge(spark, sf):
    """The table after replacing changed paths and dropping vanished ones."""
    old, new = _versions(spark, sf)
    return store.replace_by_path(old, new, "path").groupBy(F.substring("content_hash", 1, 1).alias("first")).agg(F.count("*").alias("n"), F.sum("path").alias("paths"))


_ALL = (primary_tokens, identifier_tokens, identifier_tokens_names, stop_filter, synonym_expand, query_intent, structure_intent, topic_penalty, path_token_boost, path_proximity, path_normalise, language_from_path, language_normalise, language_filter, language_stats, keep_latest, size_filter, ignore_match, line_windows, declaration_lines, negative_feedback, secret_assignments, content_hash_dedupe, snapshot_diff, snapshot_merge)
QUERIES = {f.__name__: f for f in _ALL}


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _map(table: dict[str, str]) -> str:
    return f"map({_list(table)}, {_list(table.values())})"


def _idents(x: str) -> str:
    cut = "r"
    for p in ("([a-z0-9])([A-Z])", "([A-Z])([A-Z][a-z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])", "([A-Z])([A-Z][a-z])"):
        cut = f"regexp_replace({cut}, '{p}', '\\1_\\2', 'g')"
    raws = f"list_filter(list_transform(regexp_split_to_array({x}, '[^A-Za-z0-9_]+'), lambda r: regexp_replace(r, '^_+|_+$', '', 'g')), lambda r: r <> '')"
    each = f"list_concat([lower(r)], case when contains(r, '_') then [replace(lower(r), '_', '')] else [] end, regexp_split_to_array(lower({cut}), '_+'))"
    return f"list_distinct(list_filter(flatten(list_transform({raws}, lambda r: {each})), lambda t: len(t) > 1))"


def _hashed(expr: str) -> str:
    return f"select doc_id, len(t)::bigint n_tokens, sha256(array_to_string(list_sort(t), ' ')) tokens_sha256 from (select doc_id, {expr} t from documents)"


def _any(t: str, values) -> str:
    return f"list_has_any({t}, {_list(values)})"


_PRIM = f"list_distinct({toks('text')})"
_GOOD = f"list_filter({_PRIM}, lambda t: not list_contains({_list(fixed.STOP_TOKENS)}, t) and not regexp_full_match(t, '[0-9]+'))"
_LINES = r"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '')"
_STARTS = lambda l, vs: "(" + " or ".join(f"starts_with({l}, '{v}')" for v in vs) + ")"


def _structure(x: str) -> str:
    first = rf"list_filter(string_split(coalesce({x}, ''), chr(10)), lambda l: regexp_matches(l, '^\s*(class |def |async def )'))[1]"
    return rf"case when {first} is null then '' when regexp_matches({first}, '^\s*class ') then 'class' when regexp_matches({first}, '^\s') then 'method' else 'function' end"


def _intent(x: str) -> str:
    ls = _LINES.replace("{x}", x)
    some = lambda cond: f"len(list_filter({ls}, lambda l: {cond})) > 0"
    joined = f"array_to_string({ls}, chr(10))"
    ids = f"regexp_split_to_array(lower({joined}), '[^a-z0-9_]+')"
    return rf"""case when len({ls}) = 0 then 'empty'
 when len(list_filter({ls}, lambda l: not {_STARTS('l', ['#', '//', '*'])})) = 0 then 'comment'
 when {some(_STARTS('l', fixed.IMPORT_STARTS) + " or contains(l, ' require(')")} then 'import'
 when ({_structure(x)}) <> '' or {some(_STARTS('l', fixed.DECLARATION_STARTS) + " or regexp_matches(l, '^@\\S*\\s+(.*\\s)?(public|private|protected|static|final)(\\s|$)')")} then 'declaration'
 when {_any(ids, ['except', 'catch', 'raise', 'throw'])} then 'exception'
 when {some("regexp_matches(l, '(^|[^=!<>])=([^=>]|$)')")} then 'assignment'
 when regexp_matches({joined}, '(^|[^A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*\s*\(') then 'call'
 when len(list_distinct(list_filter(list_transform({ids}, lambda t: replace(t, '_', '')), lambda t: t <> ''))) <= 2 then 'sparse' else 'mixed' end"""


_SYN = f"map({_list(fixed.SYNONYMS)}, [{', '.join(_list(v.split()) for v in fixed.SYNONYMS.values())}])"
_ASKT = f"list_distinct({toks('ask')})"
_SEG = f"list_filter(list_distinct(regexp_split_to_array(lower(topic), '[/\\\\_.-]+')), lambda s: len(s) > 1 and not list_contains({_list(fixed.GENERIC_SEGMENTS)}, s))"
_URL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_VERSIONS = """o as (select doc_id path, sha256(text) h from documents where doc_id % 11 <> 0),
n as (select doc_id path, sha256(case when doc_id % 5 = 0 then text || '!' else text end) h from documents where doc_id % 7 <> 0)"""


def _lang(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower(trim({x})), '^\\.', ''), '[_ -]', '', 'g')"
    return f"coalesce({_map(fixed.LANGUAGE_ALIASES)}[{bare}], {bare})"


SQL = {
    "primary_tokens": _hashed(_PRIM),
    "identifier_tokens": _hashed(_idents("text")),
    "identifier_tokens_names": f"with n as (select p_name || '_' || p_brand || '_' || p_type as name from part union select c_mktsegment || 'X' || c_name from customer) select name, array_to_string(list_sort({_idents('name')}), ' ') tokens from n",
    "stop_filter": _hashed(f"case when len({_GOOD}) > 0 then {_GOOD} else {_PRIM} end"),
    "synonym_expand": f"with p as (select distinct 'delete ' || o_orderpriority || ' ' || case when o_orderstatus = 'F' then 'close' else 'fetch error' end prompt from orders) select prompt, array_to_string(list_sort(list_distinct(flatten(list_transform({toks('prompt')}, lambda t: list_concat([t], coalesce({_SYN}[t], [])))))), ' ') tokens from p",
    "query_intent": f"""select conv_id, turn, {_intent('text')} intent, contains(text, chr(10)) or len(regexp_extract_all(text, '[(){{}}\\[\\].:;=,"''`]')) >= 2 code from conversations""",
    "structure_intent": f"with p as (select p_partkey, case p_partkey % 4 when 0 then 'class ' || p_brand || ':' when 1 then '  def ' || p_brand || '(x):' when 2 then '# note' || chr(10) || 'async def ' || p_brand || '(x)' else p_name end prompt from part) select p_partkey, {_structure('prompt')} structure, {_intent('prompt')} intent from p",
    "topic_penalty": f"""with p as (select p_partkey, lower({_TOPIC}) topic, {_ASK} ask from part)
select p_partkey, round(case when regexp_matches(topic, '_test\\.|/test_|/tests/|\\.test\\.|\\.spec\\.') and not {_any(_ASKT, fixed.WANTS_TESTS)} then 0.5 else 0 end
 + case when (suffix(topic, '.md') or regexp_matches(topic, 'readme|contributing|security|changelog')) and not {_any(_ASKT, fixed.WANTS_DOCS)} then 0.35 else 0 end
 + case when regexp_matches(topic, '\\.github/workflows/|\\.yml|\\.yaml') and not {_any(_ASKT, fixed.WANTS_WORKFLOWS)} then 0.08 else 0 end::double, 6) penalty from p""",
    "path_token_boost": f"""with p as (select p_partkey, {_TOPIC} topic, {_ASK} || ' ' || p_brand ask from part)
select p_partkey, round(least(len(list_filter({_ASKT}, lambda t: len(list_filter({_SEG}, lambda s: contains(s, t))) > 0)) * 0.015::double, 0.05), 6) boost from p""",
    "path_proximity": f"""with p as (select page_id, {_URL} path from pages), b as (select page_id, path, lag(path) over (partition by split_part(path, '/', 1) order by page_id) bf from p),
l as (select page_id, string_split(lower(bf), '/') x, string_split(lower(path), '/') y from b where bf is not null),
m as (select page_id, list_transform(range(1, least(len(x), len(y))), lambda i: x[i] = y[i]) s from l)
select page_id, round(least(0.04 * coalesce(nullif(list_position(s, false), 0) - 1, len(s)), 0.20)::double, 6) boost from m""",
    "path_normalise": f"select page_id, regexp_replace(regexp_replace(replace('./' || replace({_URL}, '/', chr(92)), chr(92), '/'), '^(\\./)+', ''), '^/+', '') path from pages",
    "language_from_path": f"""with p as (select p_partkey, case p_partkey % 6 when 0 then 'a/Makefile' when 1 then 'b/Dockerfile' when 2 then 'x.PY' when 3 then 'lib/y.yml' when 4 then 'z/' || p_brand else 'q/v.Markdown' end path from part),
b as (select p_partkey, lower(string_split(path, '/')[-1]) base from p)
select p_partkey, coalesce({_map(fixed.SPECIAL_FILES)}[base], {_lang("regexp_extract(base, '(\\.[^.]*)$', 1)")}) as language from b""",
    "language_normalise": f"with p as (select p_partkey, case p_partkey % 6 when 0 then ' .Java_Script' when 1 then 'C#' when 2 then 'Objective-C' when 3 then 'Type Script React' when 4 then p_brand else 'GoLang' end raw from part) select p_partkey, {_lang('raw')} as language from p",
    "language_filter": "with p as (select ['go','py','js','rs','zig','md','c'][p_partkey % 7 + 1] l from part) select l as language, count(*) n from p where l in ('asm','c','cpp','go','rs','zig','py') group by l",
    "language_stats": "select lang as language, count(*) n from documents group by lang",
    "keep_latest": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1",
    "size_filter": "select lang, count(*) n, sum(strlen(text))::bigint bytes from documents where strlen(text) <= 2048 group by lang",
    "ignore_match": "with p as (select doc_id, source || '/' || lang || '/' || doc_id path from documents) select doc_id, contains('/' || path, '/en/') or list_contains(string_split(path, '/'), 'src1') or path = 'src2/de' or starts_with(path, 'src2/de/') or regexp_full_match(path, 'src[^/]5/[^/]*') ignored from p",
    "line_windows": """with d as (select doc_id, string_split(text, chr(10)) l from documents), w as (select doc_id, l, unnest(range(1, greatest(len(l) - 2, 1)::bigint + 1, 6)) s from d)
select doc_id, (s - 1) // 6 seq, s start_line, s + len(l[s:s + 7]) - 1 end_line, sha256(array_to_string(l[s:s + 7], chr(10))) content_hash from w""",
    "declaration_lines": r"select doc_id, count(*) n from (select doc_id, unnest(string_split(text, chr(10))) l from documents) where regexp_matches(l, '^\s*(class|def|func|function|type|public|private)\s') group by doc_id",
    "negative_feedback": f"with c as (select conv_id, turn, case when conv_id % 10 = 0 then text || ' This is WRONG, useless.' else text end s from conversations), w as (select conv_id, turn, list_filter(regexp_split_to_array(lower(s), '[^\\p{{L}}\\p{{Nd}}_]+'), lambda t: list_contains({_list(fixed.NEGATIVE_WORDS)}, t))[1] sentiment from c) select * from w where sentiment is not null",
    "secret_assignments": "select doc_id, source from documents where regexp_matches(text, '" + fixed.SECRET_ASSIGNMENT.replace("'", "''") + "')",
    "content_hash_dedupe": "select sha256(text) content_hash, min(doc_id) doc_id, count(*) copies from documents group by 1",
    "snapshot_diff": f"""with {_VERSIONS}, j as (select coalesce(o.path, n.path) path, case when o.path is null then 'new' when n.path is null then 'deleted' when o.h <> n.h then 'changed' else 'same' end status from o full join n on o.path = n.path)
select status, count(*) n, sum(path)::bigint paths from j group by status""",
    "snapshot_merge": f"with {_VERSIONS}, m as (select * from n union all select * from o where path not in (select path from n) and false) select substr(h, 1, 1) as first, count(*) n, sum(path)::bigint paths from m group by 1",
}
