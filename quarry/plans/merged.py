"""Queries over source files made of documents, merged packs, and the completion proxy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code, fixed, text
from ..operators import evaluate as V
from ..operators import failure, graph, packs
from ..operators import retrieval as R
from ..sources import chunks, extract, shared
from . import evaluate as E
from . import graph as graph_plans
from . import retrieval as P
from .retrieval import read, toks




def _lines(spark, sf) -> DataFrame:
    clean = F.translate(F.coalesce("text", F.lit("")), "`$\\\r", "")
    return read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.split(clean, "\n").alias("lines"))


def _sources(spark, sf, language: str, head: str, item) -> DataFrame:
    body = F.array_join(F.transform("lines", lambda line, i: item(line, i.cast("string"))), "")
    return _lines(spark, sf).select("path", F.lit(language).alias("language"), F.concat(F.lit(head), body).alias("content"))


def _in_doc(df: DataFrame, *more) -> DataFrame:
    return df.select(F.col("path").cast("bigint").alias("doc_id"), *more)


def _js(spark, sf) -> DataFrame:
    return _sources(spark, sf, "js", "", lambda line, i: F.concat(F.lit("// about {\nfunction f"), i, F.lit("(a) {\n  return `"), line, F.lit("`;\n}\n")))


def code_spans(spark, sf):
    """Each line of a document as a function with a comment before it; prose in templates, braces in comments."""
    return _in_doc(chunks.span_table(_js(spark, sf)), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))


def _go(spark, sf) -> DataFrame:
    method = lambda line, i: F.concat(F.lit("// Tells "), i, F.lit(" {\nfunc (r *Box[K]) M"), i, F.lit("(x func(int)) (string, error) { return q.Call"), i, F.lit("(`"), line, F.lit("`) }\n"))
    kind = lambda line, i: F.concat(F.lit("type S"), i, F.lit(" struct { a string `"), line, F.lit("` }\n\n"))
    return _sources(spark, sf, "go", "package p\n", lambda line, i: F.when(i.cast("int") % 2 == 0, method(line, i)).otherwise(kind(line, i)))


def go_outline(spark, sf):
    """Methods with receivers and types, with their comments."""
    return _in_doc(extract.symbol_table(_go(spark, sf)), "name", "kind", F.col("line").cast("bigint").alias("line"), "docstring")


def go_calls(spark, sf):
    """Calls through a selector, with prose in raw strings."""
    return _in_doc(extract.reference_table(_go(spark, sf)), "name", F.col("line").cast("bigint").alias("line"))


def page_call_sites(spark, sf):
    """Calls in the scripts and styles of raw pages, each name once a page."""
    p = read(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))).alias("name"))
    return p.filter(~F.lower("name").isin("if", "for", "while", "return", "print", "len"))


_OFFERS = {"outgoing": (1, 0.82), "incoming": (-1, 0.78), "symbol_definition": (2, 0.83), "dependent_type": (3, 0.60)}


def graph_merged_pack(spark, sf):
    """The ten best documents of each item with what is next to the three best in the corpus, by relation."""
    d = P.corpus_of(spark, sf).select("id", F.concat_ws("/", F.coalesce("path", F.lit("")), F.substring_index("topic", "/", -1)).alias("path"), "topic", "text")
    c = P.candidates(spark, sf, 10).drop("path").join(d.select("id", "path"), "id").withColumn("score", F.round(1 / (1 + F.col("score")), 6))
    found = shared.written(packs.receipts(c.select("query_id", "id", "rank", "path", "topic", "text", "score"), P.queries_of(spark, sf)), "found")
    steps = F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(s).alias("step"), F.lit(k).alias("confidence")) for r, (s, k) in _OFFERS.items()])
    seeds = found.filter("rank <= 3").select("query_id", F.col("id").alias("seed"), F.explode(steps).alias("s")).select("query_id", "seed", (F.col("seed") + F.col("s.step")).alias("id"), "s.relation", "s.confidence")
    rows = seeds.join(d.select("id", "path"), "id").select("query_id", "id", "path", "relation", F.array("relation").alias("reasons"), F.array(F.concat_ws(" of ", "relation", "seed")).alias("evidence"), "confidence")
    ids = rows.groupBy("query_id", "path").agg(F.min("id").alias("id"))
    offers = graph.merge_candidates(rows.drop("id"), 16).join(ids, ["query_id", "path"]).withColumnRenamed("rank", "place").join(d.drop("path"), "id")
    m = graph.merge_into(found, offers.select("query_id", "id", "path", "text", "topic", "place", "reasons", "evidence", "confidence"), 5, 2)
    size = lambda n: F.size(n).cast("bigint").alias(f"n_{n}")
    return m.select("query_id", "rank", F.col("id").alias("doc_id"), "path", "of_graph", size("reasons"), size("evidence"), "confidence")


def completion_proxy(spark, sf):
    """The first two thirds of an item's words are the prompt, the others the line to be written; four systems order the prompt's 50 candidates."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    cut = F.floor(F.size("words") * 2 / 3).cast("int")
    b = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("words")).withColumn("k", cut)
    rest = F.slice("words", F.col("k") + 1, F.size("words"))
    cases = b.select("query_id", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("prompt"), F.array_join(rest, " ").alias("next_line"), F.get(F.filter(rest, lambda w: F.length(w) >= 5), F.lit(0)).alias("identifier"))
    index = P.kept(spark, sf)
    cases = shared.written(cases.join(E.gold_all(spark, sf, index), "query_id", "left"), "cases")
    q = cases.select("query_id", F.col("prompt").alias("text"))
    corpus = P.corpus_of(spark, sf)
    pool = shared.written(P.best(spark, sf, P.CANDIDATES, index, q).join(corpus.select("id", "text"), "id"), "pool")
    jac = R.candidate_jaccard(q, pool).withColumn("score", F.round("score", 9))
    ranks = {"bm25": pool.select("query_id", "id", F.col("rank").alias("bm25")), "jaccard": R.value_ranks(jac, "score", "jaccard")}
    fused = R.fuse(ranks, fixed.LEXICAL_WEIGHTS).withColumn("fusion", F.round("fusion", 9))
    chance = R.ranked(pool.select("query_id", "id"), F.md5(F.concat_ws(":", "query_id", "id")), F.asc("id"))
    one = lambda name, rows: rows.select(F.lit(name).alias("system"), "query_id", "id", "rank")
    tops = one("bm25", pool).unionAll(one("jaccard", ranks["jaccard"].withColumnRenamed("jaccard", "rank"))).unionAll(one("fused", R.ranked(fused, F.desc("fusion"), F.asc("id")))).unionAll(one("random", chance)).filter("rank <= 5")
    r = V.completion_proxy(cases, shared.written(tops, "tops"), corpus)
    return r.select("system", "query_id", F.col("gold_rank").cast("bigint").alias("gold_rank"), "hit1", "hit5", F.round("coverage", 6).alias("coverage"), "identifier_hit")


def document_shell_args(spark, sf):
    """every distinct word of the documents, quoted."""
    words = read(spark, sf, "documents").select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[ \n\t\r]+"))).alias("word")).distinct().filter("word <> ''")
    return words.select("word", code.shell_quoted(F.col("word")).alias("quoted"))


def page_import_predicates(spark, sf):
    """Every link of the pages as an import target, in each of six languages."""
    t = graph_plans.links(spark, sf).select("href").distinct()
    j = t.select("href", F.explode(F.array(*[F.lit(x) for x in _LANGUAGES])).alias("language"))
    return j.select("href", "language", code.resolvable(F.col("language"), F.col("href")).alias("resolvable"), code.local_import(F.col("href")).alias("local"), code.is_config_path(F.concat(F.col("href"), F.lit(".json"))).alias("config_file"), code.is_config_path(F.col("href")).alias("config"))


def document_declarations(spark, sf):
    """Lines of a document's source file that look like declarations."""
    made = _js(spark, sf).select("path", F.explode(F.split("content", "\n")).alias("line"))
    return _in_doc(made.filter(F.col("line").rlike(_DECLARES)).groupBy("path").agg(F.count("*").alias("n")), "n")


def document_frames(spark, sf):
    """The lines of a document that begin with two words as frames: the first names the file, the second the function."""
    line = lambda x, i: F.concat(F.lit('  File "src/'), F.regexp_extract(x, _TWO, 1), F.lit('.py", line '), (i % 7 + 1).cast("string"), F.lit(", in "), F.regexp_extract(x, _TWO, 2))
    said = F.array_join(F.transform("lines", lambda x, i: F.when(x.rlike(_TWO), line(x, i)).otherwise("no frame here")), "\n")
    f = failure.frames(_lines(spark, sf).select(F.col("path").alias("failure_id"), said.alias("output")))
    best = f.groupBy("failure_id", "path", "line_no").agg(F.count("*").alias("n"))
    return best.select(F.col("failure_id").cast("bigint").alias("doc_id"), "path", F.col("line_no").cast("bigint").alias("line_no"), "n")


_LANGUAGES = ("Python", "golang", "java", "rust", "js", "c")
_DECLARES = r"^\s*(class|def|func|function|type|public|private)\s"
_TWO = r"^([A-Za-z]+) ([a-z]+)"

_ALL = (document_shell_args, page_import_predicates, document_declarations, document_frames, code_spans, go_outline, go_calls, page_call_sites, graph_merged_pack, completion_proxy)
QUERIES = {f.__name__: f for f in _ALL}

_L = "l as materialized (select doc_id, unnest(range(0, len(string_split(translate(coalesce(text, ''), '`$\\' || chr(13), ''), chr(10))))) i from documents)"
_MOVES = " union all ".join(f"select '{r}' rel, {s} step, {k}::double conf" for r, (s, k) in _OFFERS.items())
_SEEN = "case when n >= 2 then 0.62 when n = 1 then 0.58 else 0.55 end::double"


def _stop() -> str:
    return "[" + ", ".join(f"'{w}'" for w in fixed.STOP_TOKENS) + "]"


_CASES = f"""cs as materialized (select item_id, array_to_string(w[1:floor(len(w) * 2 / 3)::int], ' ') "text", w, floor(len(w) * 2 / 3)::int k from (select item_id, string_split(coalesce("text", ''), ' ') w from benchmark)),
cx as materialized (select item_id query_id, array_to_string(w[k + 1:], ' ') line, list_filter(w[k + 1:], lambda x: len(x) >= 5)[1] ident, "text" prompt from cs)"""
_CLEAN_SQL = "translate(coalesce(text, ''), '`$\\' || chr(13), '')"
SQL = {
    "document_shell_args": r"""with w as (select distinct unnest(regexp_split_to_array(coalesce(text, ''), '[ \n\t\r]+')) word from documents)
select word, case when regexp_full_match(word, '[A-Za-z0-9_./:@%+=,-]+') then word else '''' || replace(word, '''', '''\''''') || '''' end quoted from w where word <> ''""",
    "page_import_predicates": f"""with h as (select distinct h href, trim(h) t from (select unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) h from pages)), l as (select unnest({list(_LANGUAGES)}) as language)
select href, language, t <> '' and (t[1] in ('.', '/') or t[1:2] = '@/' or case language when 'Python' then true when 'java' then contains(t, '.') when 'rust' then contains(t, '::') or regexp_matches(t, '^(crate|self|super)') when 'golang' then contains(t, '/') when 'js' then contains(t, '/') or contains(t, chr(92)) else contains(t, '/') or contains(t, chr(92)) or contains(t, '.') end) resolvable,
 t <> '' and (contains(t, '.') or contains(t, '/') or contains(t, chr(92))) as local, true config_file, regexp_matches(replace(lower(href), chr(92), '/'), '/configs?/|(config|settings)[^/]*$|\\.(toml|yaml|yml|json|env)$') config from h, l""",
    "document_declarations": f"""with x as (select doc_id, unnest(string_split({_CLEAN_SQL}, chr(10))) b from documents), k as (select doc_id, unnest(['// about {{', 'function f(a)', '  return `' || b || '`;', '}}']) l from x)
select doc_id, count(*) n from k where regexp_matches(l, '^\\s*(class|def|func|function|type|public|private)\\s') group by doc_id""",
    "document_frames": f"""with x as (select doc_id, unnest(string_split({_CLEAN_SQL}, chr(10))) b, unnest(range(0, len(string_split({_CLEAN_SQL}, chr(10))))) i from documents)
select distinct doc_id, 'src/' || regexp_extract(b, '^([A-Za-z]+) ([a-z]+)', 1) || '.py' path, i % 7 + 1 line_no, 1::bigint n from x where regexp_matches(b, '^([A-Za-z]+) ([a-z]+)')""",
    "code_spans": f"with {_L} select doc_id, 4 * i + 2 start_line, 4 * i + 4 end_line from l",
    "go_outline": f"with {_L} select doc_id, case when i % 2 = 0 then 'M' else 'S' end || i as name, case when i % 2 = 0 then 'method' else 'type' end kind, 2 + 2 * i + case when i % 2 = 0 then 1 else 0 end line, case when i % 2 = 0 then 'Tells ' || i || ' {{' else '' end docstring from l",
    "go_calls": f"with {_L} select doc_id, 'Call' || i as name, 3 + 2 * i line from l where i % 2 = 0",
    "page_call_sites": r"select distinct page_id, n as name from (select page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) n from pages) where lower(n) not in ('if', 'for', 'while', 'return', 'print', 'len')",
    "graph_merged_pack": f"""with {P._CAND},
dd as materialized (select id, array_to_string(list_filter([coalesce(path, ''), split_part(topic, '/', -1)], lambda x: x is not null), '/') path, topic, text from dt),
kq as (select query_id, list_filter(qt, lambda t: not list_contains({_stop()}, t) and not regexp_full_match(t, '[0-9]+')) g, qt from q),
f0 as (select c.query_id, c.id, c.rank, dd.path, len(list_intersect(case when len(g) > 0 then g else qt end, {toks("dd.topic || ' ' || dd.text")})) n from c join kq using (query_id) join dd on dd.id = c.id where c.rank <= 10),
f as materialized (select query_id, id, rank, path, case when n >= 2 then least(n, 8) else 0 end ne, 1 + (n > 0)::int + regexp_matches(path, '(^|/)tests?/|(^|/)test_|_test\\.|\\.test\\.|\\.spec\\.|_spec\\.')::int nr, {_SEEN} conf from f0),
mv as ({_MOVES}),
o as (select f.query_id, dd.path, dd.id, rel, rel || ' of ' || f.id ev, mv.conf, 50 + case rel when 'incoming' then 15 when 'symbol_reference' then 18 when 'symbol_definition' then 22 when 'dependent_type' then 26 else 0 end + case when regexp_matches(dd.path, '(^|/)tests?/|(^|/)test_|_test\\.|\\.test\\.|\\.spec\\.|_spec\\.') then 20 else 0 end p from f, mv join dd on dd.id = f.id + mv.step where f.rank <= 3),
g as (select query_id, path, min(id) id, max(p) p, max(conf) conf, count(distinct rel) nr, count(distinct ev) ne from o group by query_id, path),
h as (select *, row_number() over (partition by query_id order by p desc, path) place from g qualify place <= 16),
s as (select h.*, h.path is distinct from l.path fresh, sum((h.path is distinct from l.path)::int) over (partition by h.query_id order by place rows unbounded preceding) taken from h join f l on l.query_id = h.query_id and l.rank = 1),
a as materialized (select *, fresh and taken <= 2 added from s where taken < 2 or (fresh and taken <= 2)),
u as (select f.query_id, f.id, f.path, false og, f.nr + coalesce(a.nr, 0) nr, f.ne + coalesce(a.ne, 0) ne, greatest(f.conf, coalesce(a.conf, 0)) conf, 0 turn, 1 x from f left join a on a.query_id = f.query_id and not a.added and a.path is not distinct from f.path where f.rank = 1 and f.id not in (select a2.id from a a2 where a2.query_id = f.query_id and a2.added)
 union all select a.query_id, a.id, a.path, true, a.nr + coalesce(f.nr, 0), a.ne + coalesce(f.ne, 0), greatest(a.conf, coalesce(f.conf, 0)), 1, place from a left join f on f.query_id = a.query_id and f.id = a.id where added
 union all select f.query_id, f.id, f.path, false, f.nr, f.ne, f.conf, 2, rank from f where rank > 1 and not exists (select 1 from a where a.query_id = f.query_id and a.id = f.id and a.added))
select query_id, row_number() over (partition by query_id order by turn, x, id) rank, id doc_id, path, og of_graph, nr::bigint n_reasons, ne::bigint n_evidence, conf::double confidence from u qualify rank <= 5""",
    "completion_proxy": f"""with {_CASES}, {P._RANKS.replace("from benchmark)", "from cs)")},
go as materialized (select item_id query_id, min(doc_id) gold from benchmark b join documents d on contains(d.text, b.text) group by item_id),
fu as (select query_id, id, round(sum(p), 9) f from (select query_id, id, {fixed.LEXICAL_WEIGHTS["bm25"]} / (60 + rank) p from c union all select query_id, id, {fixed.LEXICAL_WEIGHTS["jaccard"]} / (60 + r) from rj) group by query_id, id),
tp as materialized (select 'bm25' system, query_id, id, rank from c where rank <= 5 union all select 'jaccard', query_id, id, r from rj where r <= 5
 union all select 'fused', query_id, id, row_number() over (partition by query_id order by f desc, id) r from fu qualify r <= 5
 union all select 'random', query_id, id, row_number() over (partition by query_id order by md5(query_id || ':' || id), id) r from c qualify r <= 5),
nw as (select query_id, ident, list_filter(list_distinct({toks("line")}), lambda t: not list_contains({toks("prompt")}, t)) new from cx),
hd as (select system, query_id, len(list_distinct(flatten(list(list_intersect(new, ts))))) held, coalesce(bool_or(coalesce(ident, '') <> '' and contains(dt.text, ident)), false) ih from tp join nw using (query_id) join dt using (id) group by system, query_id),
gr as (select system, tp.query_id, min(rank) g from tp join go on go.query_id = tp.query_id and go.gold = tp.id group by system, tp.query_id)
select e.system, e.query_id, g gold_rank, coalesce(g <= 1, false) hit1, coalesce(g <= 5, false) hit5, round(case when len(new) > 0 then coalesce(held, 0) / len(new) else 0 end, 6)::double coverage, coalesce(ih, false) identifier_hit
from (select distinct system, query_id from tp) e join nw using (query_id) left join hd using (system, query_id) left join gr using (system, query_id)""",
}
