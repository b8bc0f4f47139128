"""Scans, sinks, predicates, joins and list operators over tables made of `part`, `nation` and `documents`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import code, text
from ..operators import candidates as C
from ..operators import failure, graph, metadata, packs, store
from ..operators import retrieval as R
from ..sources import chunks, files
from . import retrieval as P
from .graph import _RES, resolved
from .graph import files as module_files
from .metadata import _STOPS
from .retrieval import read, toks

_LOW = "lower(replace(p_brand, '#', '_'))"


def _part(spark, sf, **columns):
    return read(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in columns.items()])


# Sources and sinks.


def recency_scan(spark, sf):
    """S09."""
    return C.newest(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path")), 10)


def small_corpus_backfill(spark, sf):
    """The nations are few, so each region is filled up from all of them."""
    n = read(spark, sf, "nation")
    have = n.select(F.col("n_regionkey").alias("query_id"), F.col("n_nationkey").alias("id"), F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).cast("bigint").alias("ord"))
    return C.small_corpus(have, n.select(F.col("n_nationkey").alias("id")), 30)


def path_chunks(spark, sf):
    """S12."""
    k = read(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("start_line"))
    return C.chunks_of_paths(k.select("path"), k, 5).select("path", "id", "start_line")


def _knowledge(spark, sf):
    own = f"case substr(p_brand, -1) when '1' then concat('src/', {_LOW}, '.py') when '2' then concat('app/src/', {_LOW}, '.py') else concat({_LOW}, '.py') end"
    return _part(spark, sf, path=own).distinct().select("path", F.explode(F.sequence(F.lit(1), F.lit(41), F.lit(10))).alias("start_line")).withColumn("end_line", F.col("start_line") + 9)


def snippet_at(spark, sf):
    """Of each place the chunk that holds it, by the longest shared tail of its path."""
    f = _part(spark, sf, failure_id="p_partkey", at="0", line_no="p_size", function="''", path=f"concat('src/', {_LOW}, '.py')")
    return failure.located(f, _knowledge(spark, sf)).select("failure_id", "path", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def path_languages(spark, sf):
    """S14, A05."""
    return C.path_languages(read(spark, sf, "documents").select(F.col("source").alias("path"), F.col("lang").alias("language")))


def language_chunks(spark, sf):
    """Files that fit are one chunk each."""
    f = _part(spark, sf, path="concat('src/m', p_partkey, '.py')", language="'py'", content="concat('def f', p_partkey, '():\\n    return ', p_size, '\\n')")
    return chunks.chunk(f).select("path", "topic", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), "content_hash")


def replace_paths(spark, sf):
    """S18."""
    rows = _part(spark, sf, path="p_brand", line="p_partkey", size="p_size")
    return store.replace_by_path(rows.withColumn("state", F.lit("old")), rows.filter("size > 45 and path like '%1'").withColumn("state", F.lit("new")), "path", True).select("path", "line", "state")


def delete_paths(spark, sf):
    """S19."""
    rows = _part(spark, sf, path="p_brand", line="p_partkey")
    return store.without(rows, rows.filter("path like '%3'")).select("path", "line")


def context_load(spark, sf):
    """Documents as files, 64 KiB of them."""
    d = read(spark, sf, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), F.col("text").alias("content"))
    return files.context_load(d, 1 << 16).select("path", "taken")


def context_vocabulary(spark, sf):
    return files.vocabulary(_part(spark, sf, content="concat(p_name, ' ', p_type, ' x_', p_size)"))


_FORBIDDEN = [("key assignment", r"(?i)(password|secret)\s*[:=]"), ("rights", r"(?i)all rights reserved"), ("mail", r"[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}")]


def forbidden_lines(spark, sf):
    """V13."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    f = files.forbidden_lines(d, _FORBIDDEN)
    return f.select(F.col("path").alias("doc_id"), F.col("line").cast("bigint").alias("line"), "label", F.sha2("found", 256).alias("found_sha256"))


def ensured_columns(spark, sf):
    """H12."""
    return store.ensure_columns(read(spark, sf, "region").select("r_regionkey", "r_name"), {"r_name": "string", "target": "string", "weight": "double"})


def table_counts(spark, sf):
    """A01."""
    return store.row_counts({t: read(spark, sf, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")})


def latest_stamps(spark, sf):
    """A04."""
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").cast("string").alias("stamp"))
    return store.newest_stamp(o, "path", "stamp")


def json_rows(spark, sf):
    """F32."""
    n = read(spark, sf, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("row"))
    return n.select("row", F.from_json("row", "id bigint, name string").getField("name").alias("name"))


# Predicates and token lists.


def prefix_search(spark, sf):
    """Parts with a word that begins as a nation's name does."""
    q = read(spark, sf, "nation").select(F.col("n_nationkey").alias("query_id"), F.expr("lower(substr(n_name, 1, 2))").alias("text"))
    hits = metadata.prefix_hits(_part(spark, sf, id="p_partkey", text="p_name"), q).groupBy("query_id").agg(F.count("*").alias("ids"), F.sum("tokens").alias("tokens"))
    return q.join(hits, "query_id", "left").select("query_id", metadata.prefix_query(text.primary_tokens(F.col("text"))).alias("fts"), F.coalesce("ids", F.lit(0)).alias("ids"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


_ASKED = "case p_partkey % 3 when 0 then 'python' when 1 then concat('sort ', p_name, ' in python') else p_name end"


def language_free_tokens(spark, sf):
    """P04, P07."""
    p = _part(spark, sf, p_partkey="p_partkey", prompt=_ASKED)
    left = code.without_language(text.primary_tokens(F.col("prompt")), code.detected_language(F.col("prompt")))
    return p.select("p_partkey", F.array_join(left, " ").alias("tokens"))


_TARGET = "case p_partkey % 7 when 0 then './util' when 1 then concat('@/lib/', p_size) when 2 then concat('pkg/', p_size) when 3 then 'crate::a' when 4 then 'java.util.List' when 5 then 'os' else '' end"
_LANG = "case p_size % 6 when 0 then 'Python' when 1 then 'js' when 2 then 'golang' when 3 then 'java' when 4 then 'rust' else 'c' end"


def import_predicates(spark, sf):
    """P17, P18."""
    p = _part(spark, sf, p_partkey="p_partkey", target=_TARGET, language=_LANG)
    l, t = F.col("language"), F.col("target")
    return p.select("p_partkey", code.resolvable(l, t).alias("resolvable"), code.local_import(t).alias("local"), code.has_references(l).alias("refs"), code.has_imports(l).alias("imports"))


_CONF = f"case p_partkey % 7 when 0 then concat('a/config/', {_LOW}, '.py') when 1 then concat('src/', {_LOW}, '_config.py') when 2 then concat('src/', {_LOW}, '.toml') when 3 then 'pkg/Settings.java' when 4 then '.env' when 5 then concat('configs/', {_LOW}) else concat('src/', {_LOW}, '.py') end"


def config_paths(spark, sf):
    """P19."""
    return _part(spark, sf, p_partkey="p_partkey", path=_CONF).select("p_partkey", "path", code.is_config_path(F.col("path")).alias("config"))


_SAID = f"case p_partkey % 4 when 0 then concat('import ', {_LOW}) when 1 then 'class Widget:' when 2 then 'run_it(x)' else p_name end"
_ROUTE_LANG = "case p_size % 3 when 0 then 'java' when 1 then 'py' else 'go' end"


def profile_routes(spark, sf):
    """P14, E03."""
    p = _part(spark, sf, p_partkey="p_partkey", prompt=_SAID, language=_ROUTE_LANG)
    s, c = code.profile_routes("language_symbol_cards", F.col("prompt"), F.col("language"))
    off, _ = code.profile_routes("none", F.col("prompt"), F.col("language"))
    return p.select("p_partkey", s.alias("symbols"), c.alias("cards"), off.alias("without"))


def suffix_paths(spark, sf):
    """P15."""
    p = _part(spark, sf, p_partkey="p_partkey", a=f"concat('src/', {_LOW}, '.py')", b=f"case p_size % 3 when 0 then concat({_LOW}, '.py') when 1 then concat('app/src/', {_LOW}, '.py') else concat('b', {_LOW}, '.py') end")
    return p.select("p_partkey", code.suffix_match(F.col("a"), F.col("b")).alias("same"))


def extra_tokens(spark, sf):
    """U05, H05."""
    p = _part(spark, sf, p_partkey="p_partkey", tokens="p_type", primary="p_name")
    own = code.extra_tokens(text.tokens(F.concat_ws(" ", "tokens", "primary")), text.primary_tokens(F.col("primary")))
    return p.select("p_partkey", F.array_join(own, " ").alias("extra"), code.widens(text.tokens(F.col("tokens")), text.primary_tokens(F.col("primary"))).alias("widens"))


_MODE = "case p_partkey % 6 when 0 then 'debug' when 1 then 'refactor' when 2 then 'test' when 3 then 'review' when 4 then 'docs' else '' end"
_MODE_QUERY = "case p_size % 3 when 0 then concat(p_name, ' Error test') else p_name end"


def mode_queries(spark, sf):
    """F25."""
    p = _part(spark, sf, p_partkey="p_partkey", query=_MODE_QUERY, mode=_MODE)
    return p.select("p_partkey", packs.mode_query(F.col("query"), F.col("mode")).alias("query"))


_ARG = "case p_partkey % 3 when 0 then concat('./', p_size, '.py') when 1 then p_name else concat('it''s ', p_size) end"


def shell_args(spark, sf):
    """F26."""
    return read(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("./"), F.col("p_size"), F.lit(".py"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit("it's "), F.col("p_size"))).alias("arg")).select("p_partkey", code.shell_quoted(F.col("arg")).alias("quoted"))


def completion_lines(spark, sf):
    """exact and trimmed agreement of what was said with what was wanted."""
    p = _part(spark, sf, p_partkey="p_partkey", want="p_name", said="case p_partkey % 3 when 0 then concat('```python\\n\\n', p_name, '\\nmore') when 1 then concat('  ', p_name, ' ') else p_type end")
    first = code.first_completion_line(F.col("said"))
    return p.select("p_partkey", first.alias("first"), (first == F.col("want")).alias("exact"), (F.trim(first) == F.trim("want")).alias("trimmed"))


def bench_texts(spark, sf):
    """H16."""
    p = _part(spark, sf, p_partkey="p_partkey", imports="case when p_size % 2 = 0 then 'import a' else '' end", code="concat('one\\ntwo\\n', p_name, '\\nfour\\n')", path="p_brand", snippet="concat(p_type, '  \\n')", language="case when p_size % 2 = 0 then 'python' else 'java' end")
    return p.select("p_partkey", code.last_lines(F.col("code")).alias("tail"), code.completion_query(F.col("imports"), F.col("code")).alias("query"), code.candidate_text(F.col("language"), F.col("path"), F.lit("f"), F.col("snippet")).alias("candidate"))


_ODD = "case p_partkey % 5 when 0 then concat('a/snippet_', p_size, '.py') when 1 then concat('../', p_brand, '/x.y') when 2 then concat('C:/', p_size, '/./v1.2') when 3 then '/__/.hidden/ok name' else '' end"


def odd_paths(spark, sf):
    """H17, H23."""
    p = _part(spark, sf, p_partkey="p_partkey", path=_ODD)
    return p.select("p_partkey", code.path_number(F.col("path")).alias("number"), F.array_join(code.safe_parts(F.col("path")), "/").alias("parts"))


# Joins.


def field_hits(spark, sf):
    """J02."""
    rows = _part(spark, sf, name="p_name", signature="p_type", path="p_brand", line="p_partkey")
    q = read(spark, sf, "part").groupBy(F.col("p_size").alias("query_id")).agg(F.concat_ws(" ", F.min("p_type"), F.min("p_name")).alias("text"))
    return metadata.field_hits(rows, q, {"name": 8.0, "signature": 4.0, "path": 1.0}, 5).select("query_id", "path", "line", "score", "rank")


def file_edges(spark, sf):
    """J06 of every file."""
    return graph.file_edges(resolved(spark, sf), module_files(spark, sf))


_TYPES = "replace(p_brand, '#', '')"


def dependent_types(spark, sf):
    """Types named by a text, and those their signatures name."""
    texts = _part(spark, sf, id="p_partkey", text=f"concat('uses ', {_TYPES}, ' and API')")
    names = _part(spark, sf, name=_TYPES).distinct()
    symbols = names.select("name", F.lit("class").alias("kind"), F.concat(F.lit("t/"), "name").alias("path"), F.concat(F.lit("class "), "name", F.lit("(Base"), F.substring("name", 6, 1), F.lit(")")).alias("signature"))
    bases = names.select(F.concat(F.lit("Base"), F.substring("name", 6, 1)).alias("name")).distinct().select("name", F.lit("type").alias("kind"), F.lit("t/base").alias("path"), F.lit("type").alias("signature"))
    return metadata.dependent_types(texts, symbols.unionByName(bases))


def path_rank_boost(spark, sf):
    """J10."""
    c = _part(spark, sf, query_id="p_size", id="p_partkey", path="p_brand", primary="p_partkey % 2 = 0")
    ranks = R.top_k(c.select("query_id", "path").distinct(), 10, F.asc("path"))
    return C.structured_boost(c, ranks).select("query_id", F.col("id").alias("p_partkey"), F.round("structured", 6).alias("structured"))


def card_hits(spark, sf):
    """J11."""
    cards = _part(spark, sf, path=f"concat({_LOW}, '.py')", line="p_size", rank="p_partkey % 20 + 1").withColumn("score", 1 / (1 + F.col("rank")))
    ranges = _part(spark, sf, path=f"concat({_LOW}, '.py')").distinct().select("path", F.explode(F.sequence(F.lit(1), F.lit(41), F.lit(10))).alias("start_line")).withColumn("end_line", F.col("start_line") + 9)
    return graph.card_hits(cards, ranges).select("path", F.col("start_line").cast("bigint").alias("start_line"), "rank", F.round("score", 6).alias("score"))


_RECENT = [("src/brand_11.py", 0.05), ("brand_22.py", 0.025), ("deep/src/brand_33.py", 0.0167)]


def recent_weights(spark, sf):
    """J12."""
    c = _part(spark, sf, query_id="p_size", id="p_partkey", path=f"concat('src/', {_LOW}, '.py')")
    return C.recency(c, _RECENT).select("query_id", F.col("id").alias("p_partkey"), "recency")


def go_frames(spark, sf):
    """A Go frame's function stands on the line before."""
    out = "concat('goroutine 1 [running]:\\nmain.Run', p_size, '(0x1)\\n\\twork/', lower(replace(p_brand, '#', '_')), '.go:', p_size, ' +0x1d\\n')"
    return failure.frames(_part(spark, sf, failure_id="p_partkey", output=out)).select("failure_id", F.col("at").cast("bigint").alias("at"), "path", F.col("line_no").cast("bigint").alias("line_no"), "function")


# Ranks, samples, unions.


def best_path_ranks(spark, sf):
    """W03."""
    h = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").cast("bigint").alias("rank"))
    return C.best_path_ranks(h)


def external_rerank(spark, sf):
    """BM25's order fused with Jaccard's."""
    _, ranks = P.rank_tables(spark, sf)
    base = ranks["bm25"].withColumnRenamed("bm25", "rank").filter("rank <= 15")
    other = ranks["jaccard"].withColumnRenamed("jaccard", "place").filter("place <= 15")
    return P.shown(R.external_fusion(base, other), "before", "rank")


def score_order(spark, sf):
    """L04."""
    return R.ranked(_part(spark, sf, query_id="p_size", id="p_partkey", score="p_retailprice"), F.asc("score"), F.asc("id")).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"))


def seeded_sample(spark, sf):
    """L07."""
    return C.seeded_sample(read(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey", 20, 42).select("o_orderkey")


_GRAPH_PATH = f"case p_partkey % 4 when 0 then concat('tests/test_', {_LOW}, '.py') when 1 then concat('a/vendor/', {_LOW}, '.py') else concat('src/', {_LOW}, '.py') end"
_RELATION = "case p_partkey % 5 when 0 then 'incoming' when 1 then 'symbol_reference' when 2 then 'symbol_definition' when 3 then 'dependent_type' else 'outgoing' end"


def graph_candidates(spark, sf):
    """L05, U06."""
    rows = _part(spark, sf, query_id="p_size % 5", path=_GRAPH_PATH, relation=_RELATION, confidence="cast(p_size % 7 as double) / 10")
    rows = rows.withColumn("reasons", F.array("relation")).withColumn("evidence", F.array(F.concat(F.lit("e"), F.col("relation"))))
    m = graph.merge_candidates(rows, 16)
    return m.select("query_id", "path", F.col("priority").cast("bigint").alias("priority"), "confidence", F.array_join("reasons", ",").alias("reasons"), F.array_join("evidence", ",").alias("evidence"), F.col("rank").cast("bigint").alias("rank"))


def merged_snippets(spark, sf):
    """U07."""
    p = _part(spark, sf, query_id="p_size % 10", path="p_brand", start_line="p_size", end_line="p_size + 9", rank="p_partkey")
    return C.merge_snippets(p.filter("rank % 7 = 0"), p, 8).select("query_id", "path", F.col("start_line").cast("bigint").alias("start_line"), "focused", F.col("rank").cast("bigint").alias("rank"))


def merged_commands(spark, sf):
    """U08."""
    p = _part(spark, sf, command="p_type", confidence="cast(p_size as double) / 100", no="p_size % 3", brand="p_brand")
    groups = [p.filter(f"no = {k} and (brand like '%{k + 1}' or no = 2)") for k in range(3)]
    return graph.merge_commands(groups).select("command", F.col("group_no").cast("bigint").alias("group_no"), "confidence")


def structured_paths(spark, sf):
    """U09."""
    p = _part(spark, sf, query_id="p_size", rank="p_partkey", brand="p_brand", type="p_type", box="p_name")
    of = lambda c: p.select("query_id", "rank", F.col(c).alias("path"))
    imports = p.select("query_id", "rank", F.col("box").alias("path"), F.col("brand").alias("target_path"))
    return C.structured_paths(of("brand").filter("rank % 5 = 0"), of("type").filter("rank % 5 = 1"), imports, 12).select("query_id", "path", F.col("rank").cast("bigint").alias("rank"))


_ALL = (
    recency_scan, small_corpus_backfill, path_chunks, snippet_at, path_languages, language_chunks, replace_paths, delete_paths, context_load, context_vocabulary, forbidden_lines, ensured_columns, table_counts, latest_stamps,
    json_rows, prefix_search, language_free_tokens, import_predicates, config_paths, profile_routes, suffix_paths, extra_tokens, mode_queries, shell_args, completion_lines, bench_texts, odd_paths, field_hits, file_edges,
    dependent_types, path_rank_boost, card_hits, recent_weights, go_frames, best_path_ranks, external_rerank, score_order, seeded_sample, graph_candidates, merged_snippets, merged_commands, structured_paths,
)
QUERIES = {f.__name__: f for f in _ALL}

_TESTS = r"(^|/)tests?/|(^|/)test_|_test\.|\.test\.|\.spec\.|_spec\."
_GOOD = lambda x: f"len(list_filter({x}, lambda t: len(t) > 1 and not list_contains({_STOPS}, t) and not regexp_full_match(t, '[0-9]+'))) > 0"
_MODE_WORDS = "case mode " + " ".join(f"when '{k}' then {v.split()!r}" for k, v in packs.MODES.items()) + " else [] end"
_TAKEN = "with s as (select 'd' || lpad(doc_id::varchar, 9, '0') path, strlen(text) size from documents where strlen(text) > 0), r as (select path, size, coalesce(sum(size) over (order by path rows between unbounded preceding and 1 preceding), 0) b from s)"
_LABELS = " ".join(f"case when regexp_matches(l, '{p}') then '{n}' end," for n, p in _FORBIDDEN).rstrip(",")

SQL = {
    "recency_scan": "select doc_id id, source path from documents order by doc_id desc limit 10",
    "small_corpus_backfill": """with h as (select n_regionkey query_id, n_nationkey id, row_number() over (partition by n_regionkey order by n_nationkey) ord from nation),
m as (select query_id, max(ord) last from h group by query_id), f as (select m.query_id, n_nationkey id, last, row_number() over (partition by m.query_id order by n_nationkey) r from m, nation where (m.query_id, n_nationkey) not in (select query_id, id from h))
select query_id, id, ord from h union all select query_id, id, last + r from f where r <= 25""",
    "path_chunks": "select source path, doc_id id, doc_id % 50 start_line from documents where source is not null qualify row_number() over (partition by source order by doc_id % 50, doc_id) <= 5",
    "snippet_at": f"""with b as (select distinct p_brand, {_LOW} l from part), k as (select l, case p_brand[-1] when '1' then 'src/' || l || '.py' when '2' then 'app/src/' || l || '.py' else l || '.py' end path, unnest(range(1, 42, 10)) s from b),
f as (select p_partkey, p_size, {_LOW} l from part)
select p_partkey failure_id, path, s start_line, s + 9 end_line from f join k using (l) qualify row_number() over (partition by p_partkey order by not (p_size between s and s + 9), abs(s - p_size), s) = 1""",
    "path_languages": "select distinct source path, lang as language from documents",
    "language_chunks": "select 'src/m' || p_partkey || '.py' path, 'src/m' || p_partkey || '.py' topic, 1::bigint start_line, 2::bigint end_line, sha256('def f' || p_partkey || '():' || chr(10) || '    return ' || p_size || chr(10)) content_hash from part",
    "replace_paths": """with n as (select p_brand path, p_partkey line from part where p_size > 45 and p_brand like '%1')
select path, line, 'new' state from n union all select p_brand, p_partkey, 'old' from part where p_brand not in (select path from n)""",
    "delete_paths": "select p_brand path, p_partkey line from part where p_brand not like '%3'",
    "context_load": f"{_TAKEN} select path, least(size, 65536 - b)::bigint taken from r where b < 65536",
    "context_vocabulary": "select distinct w as word from (select unnest(regexp_extract_all(p_name || ' ' || p_type || ' x_' || p_size, '[A-Za-z0-9_]+')) w from part) where length(w) between 4 and 19",
    "forbidden_lines": f"""with d as (select doc_id, unnest(string_split(text, chr(10))) l, unnest(range(1, len(string_split(text, chr(10))) + 1)) line from documents where strlen(text) <= 2097152),
x as (select doc_id, line, unnest([{_LABELS}]) label, l from d) select doc_id, line, label, sha256(trim(l, ' ')) found_sha256 from x where label is not null""",
    "ensured_columns": "select r_regionkey, r_name, null::varchar target, null::double weight from region",
    "table_counts": " union all ".join(f"select '{t}' as \"table\", count(*) n from {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "latest_stamps": "select o_custkey path, max(o_orderdate::varchar) stamp from orders group by 1",
    "json_rows": """select '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' as "row", n_name as name from nation""",
    "prefix_search": f"""with q as (select n_nationkey query_id, lower(substr(n_name, 1, 2)) t from nation), p as (select p_partkey id, unnest(list_distinct({toks('p_name')})) w from part),
h as (select query_id, id, count(*) n from q join p on starts_with(w, t) group by query_id, id), g as (select query_id, count(*) ids, sum(n) n from h group by query_id)
select query_id, t || '*' fts, coalesce(ids, 0) ids, coalesce(n, 0)::bigint tokens from q left join g using (query_id)""",
    "language_free_tokens": f"""with p as (select p_partkey, {_ASKED} prompt from part), t as (select p_partkey, prompt, list_distinct({toks('prompt')}) a, regexp_split_to_array(lower(prompt), '[^a-z0-9]+') o from p),
k as (select p_partkey, list_filter(o, lambda x, i: len(x) > 1 and list_position(o, x) = i) a from t)
select p_partkey, array_to_string(case when list_contains(a, 'python') and len(a) > 1 then list_filter(a, lambda x: x <> 'python') else a end, ' ') tokens from k""",
    "import_predicates": f"""with p as (select p_partkey, {_TARGET} t, p_size % 6 l from part)
select p_partkey, case when t = '' then false when t[1] in ('.', '/') or starts_with(t, '@/') then true else case l when 0 then true when 1 then contains(t, '/') when 2 then contains(t, '/') when 3 then contains(t, '.') when 4 then contains(t, '::') or starts_with(t, 'crate') else contains(t, '/') or contains(t, '.') end end resolvable,
 t <> '' and (contains(t, '/') or contains(t, '.')) as local, l <> 5 refs, l <> 5 imports from p""",
    "config_paths": f"with p as (select p_partkey, {_CONF} path from part) select p_partkey, path, p_partkey % 7 in (0, 1, 2, 3, 4) config from p",
    "profile_routes": "select p_partkey, not (p_size % 3 = 0 and p_partkey % 4 = 1) symbols, p_size % 3 in (0, 1) and p_partkey % 4 in (0, 2) cards, false as \"without\" from part",
    "suffix_paths": "select p_partkey, p_size % 3 in (0, 1) same from part",
    "extra_tokens": f"""with p as (select p_partkey, regexp_split_to_array(lower(p_type || ' ' || p_name), '[^a-z0-9]+') o, {toks('p_name')} a, {toks('p_type')} t from part)
select p_partkey, array_to_string(list_filter(o, lambda x, i: len(x) > 1 and list_position(o, x) = i and not list_contains(a, x)), ' ') extra, {_GOOD("list_filter(t, lambda x: not list_contains(a, x))")} widens from p""",
    "mode_queries": f"""with p as (select p_partkey, {_MODE_QUERY} q, {_MODE} mode from part)
select p_partkey, trim(array_to_string(list_concat([q], list_filter({_MODE_WORDS}, lambda w: not list_contains(string_split(lower(q), ' '), w))), ' ')) query from p""",
    "shell_args": """select p_partkey, case p_partkey % 3 when 0 then './' || p_size || '.py' when 1 then case when regexp_full_match(p_name, '[A-Za-z0-9_./:@%+=,-]+') then p_name else '''' || p_name || '''' end else '''it''\\''''s ' || p_size || '''' end quoted from part""",
    "completion_lines": "select p_partkey, case p_partkey % 3 when 0 then p_name when 1 then '  ' || p_name || ' ' else p_type end as first, p_partkey % 3 = 0 or (p_partkey % 3 = 2 and p_type = p_name) exact, p_partkey % 3 < 2 or p_type = p_name trimmed from part",
    "bench_texts": """select p_partkey, 'two' || chr(10) || p_name || chr(10) || 'four' tail, case when p_size % 2 = 0 then 'import a' || chr(10) else '' end || 'two' || chr(10) || p_name || chr(10) || 'four' query,
 case when p_size % 2 = 0 then '#' else '//' end || ' Path: ' || p_brand || chr(10) || case when p_size % 2 = 0 then '#' else '//' end || ' Identifier: f' || chr(10) || p_type || chr(10) candidate from part""",
    "odd_paths": """select p_partkey, case p_partkey % 5 when 0 then p_size when 2 then 1 end::bigint number, case p_partkey % 5 when 0 then 'a/snippet_' || p_size || '.py' when 1 then replace(p_brand, '#', '_') || '/x.y' when 2 then p_size || '/v1.2' when 3 then 'hidden/ok_name' else '' end parts from part""",
    "field_hits": f"""with q as (select p_size query_id, unnest(list_distinct({toks("min(p_type) || ' ' || min(p_name)")})) t from part group by p_size),
r as (select p_brand path, p_partkey line, unnest({toks('p_name')}) t, 8.0::double w from part union all select p_brand, p_partkey, unnest({toks('p_type')}), 4.0 from part union all select p_brand, p_partkey, unnest({toks('p_brand')}), 1.0 from part),
s as (select query_id, path, line, sum(w) score from q join r using (t) group by query_id, path, line)
select query_id, path, line, score, row_number() over (partition by query_id order by score desc, path, line) rank from s qualify rank <= 5""",
    "file_edges": f"with {_RES} select src path, dst other, 'out' direction from g union all select dst, src, 'in' from g",
    "dependent_types": """with p as (select p_partkey id, replace(p_brand, '#', '') n from part)
select id, 't/' || n path, n as name, 1 as depth from p union all select id, 't/base', 'Base' || substr(n, 6, 1), 2 from p""",
    "path_rank_boost": """with c as (select p_size query_id, p_partkey, p_brand from part), r as (select query_id, p_brand, row_number() over (partition by query_id order by p_brand) k from (select distinct query_id, p_brand from c))
select query_id, p_partkey, round(case when k <= 10 and p_partkey % 2 <> 0 then 0.02::double / sqrt(k) else 0 end, 6) structured from c join r using (query_id, p_brand)""",
    "card_hits": f"""with c as (select {_LOW} || '.py' path, ((p_size - 1) // 10) * 10 + 1 s, p_partkey % 20 + 1 r from part)
select path, s::bigint start_line, min(r) rank, round(1.15::double * max(1.0::double / (1 + r)), 6) score from c group by path, s""",
    "recent_weights": f"select p_size query_id, p_partkey, case {_LOW} when 'brand_11' then 0.05 when 'brand_22' then 0.025 when 'brand_33' then 0.0167 else 0.0 end::double recency from part",
    "go_frames": f"select p_partkey failure_id, 2::bigint as \"at\", 'work/' || {_LOW} || '.go' path, p_size::bigint line_no, 'Run' || p_size as function from part",
    "best_path_ranks": "select l_orderkey % 50 query_id, l_partkey id, min(l_linenumber)::bigint rank from lineitem group by 1, 2",
    "external_rerank": f"""with {P._RANKS}, b as (select query_id, id, rank from c where rank <= 15), n as (select query_id, count(*) k from b group by query_id),
f as (select b.query_id, b.id, b.rank before, round(1.0::double / (20 + b.rank) + 1.0::double / (20 + coalesce(case when r <= 15 then r end, k + 1)), 12) f from b join n using (query_id) left join rj on rj.query_id = b.query_id and rj.id = b.id)
select query_id, id doc_id, before, row_number() over (partition by query_id order by f desc, before, id) rank from f""",
    "score_order": "select p_size query_id, p_partkey id, row_number() over (partition by p_size order by p_retailprice, p_partkey) rank from part",
    "seeded_sample": "select o_orderkey from orders order by md5('42:' || o_orderkey), o_orderkey limit 20",
    "graph_candidates": f"""with r as (select p_size % 5 query_id, {_GRAPH_PATH} path, {_RELATION} rel, (p_size % 7)::double / 10 c from part),
k as (select *, 50 + case rel when 'incoming' then 15 when 'symbol_reference' then 18 when 'symbol_definition' then 22 when 'dependent_type' then 26 else 0 end + case when regexp_matches(path, '{_TESTS}') then 20 else 0 end - case when path like '%/vendor/%' then 30 else 0 end p from r),
g as (select query_id, path, max(p) priority, max(c) confidence, string_agg(distinct rel, ',' order by rel) reasons, string_agg(distinct 'e' || rel, ',' order by 'e' || rel) evidence from k group by query_id, path)
select query_id, path, priority::bigint priority, confidence, reasons, evidence, row_number() over (partition by query_id order by priority desc, path) rank from g qualify rank <= 16""",
    "merged_snippets": """with p as (select p_size % 10 query_id, p_brand path, p_size s, p_partkey k from part), u as (select *, 0 o from p where k % 7 = 0 union all select *, 1 from p),
g as (select query_id, path, s, o, k from u qualify row_number() over (partition by query_id, path, s order by o, k) = 1)
select query_id, path, s::bigint start_line, o = 0 focused, row_number() over (partition by query_id order by o, k, path, s) rank from g qualify rank <= 8""",
    "merged_commands": """with p as (select p_type command, p_size::double / 100 c, p_size % 3 no, p_brand b from part),
g as (select * from p where no = 0 and b like '%1' or no = 1 and b like '%2' or no = 2)
select command, no::bigint group_no, max(c) confidence from g group by command, no qualify row_number() over (partition by command order by no) = 1""",
    "structured_paths": """with p as (select p_size query_id, p_partkey k, p_brand b, p_type t, p_name x from part),
u as (select query_id, b path, 0 n, k, 0 s from p where k % 5 = 0 union all select query_id, t, 1, k, 0 from p where k % 5 = 1 union all select query_id, b, 2, k, 0 from p union all select query_id, x, 2, k, 1 from p),
o as (select * from u qualify row_number() over (partition by query_id, path order by n, k, s) = 1)
select query_id, path, row_number() over (partition by query_id order by n, k, s, path) rank from o qualify rank <= 12""",
}
