"""Graph queries: over page links and over files and imports derived from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import retrieval as R
from .retrieval import read


def links(spark, sf):
    """page_id, host, href of `<a href>`."""
    p = read(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return p


def html_links(spark, sf):
    return links(spark, sf).groupBy("page_id").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


def html_imports(spark, sf):
    """X10 of HTML: scripts, style sheets, images, frames."""
    pattern = r"""(?i)<(?:script|img|source|iframe)[^>]+src=["']([^"']+)["']|<link[^>]+href=["']([^"']+)["']"""
    p = read(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).cast("bigint").alias("imports"))
    return p


def link_in_degree(spark, sf):
    e = links(spark, sf).select(F.col("page_id").alias("src"), F.col("href").alias("dst"))
    return G.in_degree(e).select(F.col("node").alias("href"), "edges", "sources")


def files(spark, sf):
    return read(spark, sf, "part").select(
        F.expr("concat('src/', lower(replace(p_brand, '#', '_')), '/', case when p_partkey % 9 = 0 then 'test_' else '' end, 'm', p_partkey % 1500, '.py')").alias("path"), F.col("p_partkey").alias("k"), F.lit("py").alias("language")
    )


def import_edges(spark, sf):
    name = "concat('m', (p_partkey * 7) % 1700)"
    return read(spark, sf, "part").select(
        F.expr("concat('src/', lower(replace(p_brand, '#', '_')), '/', case when p_partkey % 9 = 0 then 'test_' else '' end, 'm', p_partkey % 1500, '.py')").alias("path"),
        F.col("p_partkey").alias("line"),
        F.expr(f"array(concat('src/', lower(replace(p_brand, '#', '_')), '/', {name}, '.py'), concat({name}, '.py'), concat('test_', {name}, '.py'))").alias("candidates"),
    )


def import_resolution(spark, sf):
    r = G.resolve_imports(import_edges(spark, sf), files(spark, sf).select("path").distinct())
    return r.select("path", "line", "target_path")


def resolved(spark, sf):
    return import_resolution(spark, sf).filter("target_path is not null").select(F.col("path").alias("src"), F.col("target_path").alias("dst")).distinct()


def import_neighbours(spark, sf):
    seeds = files(spark, sf).filter("k % 100 = 0").select(F.col("path").alias("seed")).distinct()
    return G.neighbours(resolved(spark, sf), seeds, 2)


def symbols(spark, sf):
    return read(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), F.expr("element_at(array('class','function','method','type'), cast(p_size % 4 as int) + 1)").alias("kind"), F.expr("if(p_size % 3 = 0, 'py', 'go')").alias("language"), F.concat(F.lit("a/"), F.col("p_brand")).alias("path"), F.col("p_partkey").alias("line"))


def references(spark, sf):
    return read(spark, sf, "part").select(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name"), F.expr("if(p_size % 2 = 0, 'py', 'go')").alias("language"), F.concat(F.lit("b/"), F.col("p_type")).alias("path"), F.col("p_partkey").alias("line"))


def _callers_of(d, r):
    return G.callers(d, r).select("def_name", "def_path", "def_language", "path", "line", "place")


def callers_all(spark, sf):
    """J03 of every definition."""
    return _callers_of(symbols(spark, sf), references(spark, sf))


def _definitions_of(r, d):
    return G.definitions_of(r, d).select("ref_name", "ref_path", "ref_line", "kind", "path", "line", "place")


def definitions_all(spark, sf):
    """J04 of every call site."""
    return _definitions_of(references(spark, sf), symbols(spark, sf))


def line_range_join(spark, sf):
    """Token positions within line windows of documents."""
    d = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "\n")).alias("at", "body")).select("path", (F.col("at") + 1).alias("line"), F.length("body").alias("size"))
    ranges = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.size(F.split("text", "\n")).alias("n")).select("path", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(5))).alias("start_line"), "n").select("path", "start_line", (F.col("start_line") + 7).alias("end_line"))
    g = G.in_ranges(d, ranges).groupBy("path", "start_line").agg(F.count("*").alias("lines"), F.sum("size").cast("bigint").alias("chars"))
    return g.select(F.col("path").alias("doc_id"), F.col("start_line").cast("bigint").alias("start_line"), "lines", "chars")


def _signals(spark, sf):
    e = resolved(spark, sf)
    out = e.select(F.col("src").alias("source_path"), F.col("dst").alias("path"), F.lit("imported").alias("signal"))
    back = e.select(F.col("dst").alias("source_path"), F.col("src").alias("path"), F.lit("importer").alias("signal"))
    a, b = e.select("src", "dst"), e.select(F.col("src").alias("other"), "dst")
    shared = a.join(b, "dst").filter("src <> other").select(F.col("src").alias("source_path"), F.col("other").alias("path"), F.lit("shared_import").alias("signal"))
    return out.unionAll(back).unionAll(shared)


def related_scores(spark, sf):
    return G.related(_signals(spark, sf), 5).select("source_path", "path", "score", "rank")


def _affected_by(spark, sf, changed):
    a = G.affected(changed.select("path").distinct(), files(spark, sf).select("path").distinct(), G.related(_signals(spark, sf), 5), 100_000)
    return a.select("path", "confidence", F.array_join("reasons", "; ").alias("reasons"))


def affected_paths_all(spark, sf):
    """K12 with every file changed; there are fewer paths than the limit, 25 brands with 3000 at most."""
    return _affected_by(spark, sf, files(spark, sf))


def call_sites(spark, sf):
    """Names before an opening bracket, by line, without those that open the line's own definition."""
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    names = d.select("doc_id", (F.col("line") + 1).cast("bigint").alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))).alias("name"))
    return names.filter(~F.lower("name").isin("if", "for", "while", "return", "print", "len"))


def cards_union(spark, sf):
    """X11: cards of symbols, calls and imports, unique by kind, name and line, with their weights."""
    s = symbols(spark, sf).select(F.when(F.col("name").startswith("test"), "test").otherwise("symbol").alias("kind"), "name", "path", "line")
    r = references(spark, sf).select(F.lit("usage").alias("kind"), "name", "path", "line")
    i = import_edges(spark, sf).select(F.lit("import").alias("kind"), F.get("candidates", F.lit(1)).alias("name"), "path", "line")
    from ..functions.fixed import CARD_WEIGHTS

    weight = F.create_map(*[F.lit(x) for kv in CARD_WEIGHTS.items() for x in kv])
    u = s.unionAll(r).unionAll(i).dropDuplicates(["kind", "name", "path", "line"]).withColumn("weight", F.try_element_at(weight, F.col("kind")))
    return u.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.round(F.sum("weight"), 4).alias("weight"))


def repo_map(spark, sf):
    """At most 25 symbols a file, by line, of the 20 files with most."""
    s = symbols(spark, sf)
    top = s.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(20)
    r = R.top_k(s.join(top, "path"), 25, F.asc("line"), by="path")
    g = r.groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("s"))
    return g.select("path", "n", F.array_join(F.transform("s", lambda x: x["name"]), ",").alias("names"))


_ALL = (html_links, html_imports, link_in_degree, import_resolution, import_neighbours, callers_all, definitions_all, line_range_join, related_scores, affected_paths_all, call_sites, cards_union, repo_map)
QUERIES = {f.__name__: f for f in _ALL}

_PATH = "'src/' || lower(replace(p_brand, '#', '_')) || '/' || case when p_partkey % 9 = 0 then 'test_' else '' end || 'm' || p_partkey % 1500 || '.py'"
_NAME = "'m' || (p_partkey * 7) % 1700"
_TEST = r"regexp_matches({x}, '(^|/)tests?/|(^|/)test_|_test\.|\.test\.|\.spec\.|_spec\.')"
_RES = f"""f as materialized (select distinct {_PATH} path from part),
fs as materialized (select path target, array_to_string(string_split(path, '/')[i:], '/') key from f, lateral (select unnest(range(1, len(string_split(path, '/')) + 1)) i)),
e as materialized (select {_PATH} path, p_partkey line, unnest(['src/' || lower(replace(p_brand, '#', '_')) || '/' || {_NAME} || '.py', {_NAME} || '.py', 'test_' || {_NAME} || '.py']) key, unnest([0, 1, 2]) no from part),
m as (select e.path, line, target from e join fs using (key) where target <> e.path qualify row_number() over (partition by e.path, line order by no, key <> target, {_TEST.replace('{x}', 'target')}, length(target), target) = 1),
r as materialized (select distinct e.path, e.line, target from e left join m on e.path = m.path and e.line = m.line),
g as materialized (select distinct path src, target dst from r where target is not null)"""
_SIGN = f"""{_RES},
sg as (select src source_path, dst path, 9 w from g union all select dst, src, 10 from g union all select a.src, b.src, 2 from g a join g b on a.dst = b.dst where a.src <> b.src),
sc as (select source_path, path, sum(w)::bigint score from sg where source_path <> path group by source_path, path),
rel as materialized (select *, row_number() over (partition by source_path order by score desc, path) rank from sc)"""
_SYM = "select split_part(p_name, ' ', 1) as name, ['class','function','method','type'][p_size % 4 + 1] kind, case when p_size % 3 = 0 then 'py' else 'go' end lang, 'a/' || p_brand path, p_partkey line from part"
_REF = "select upper(split_part(p_name, ' ', 1)) as name, case when p_size % 2 = 0 then 'py' else 'go' end lang, 'b/' || p_type path, p_partkey line from part"
_DIR = "regexp_replace(path, '/[^/]*$', '')"
_STEM = "regexp_extract(path, '([^/]*)\\.py$', 1)"

SQL = {
    "html_links": """select page_id, count(*) links, count(distinct h) targets from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) h from pages) group by page_id""",
    "html_imports": """select page_id, len(regexp_extract_all(html, '(?i)<(?:script|img|source|iframe)[^>]+src=["'']([^"'']+)["'']|<link[^>]+href=["'']([^"'']+)["'']'))::bigint imports from pages""",
    "link_in_degree": """select h href, count(*) edges, count(distinct page_id) sources from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) h from pages) group by h""",
    "import_resolution": f"with {_RES} select path, line, target target_path from r",
    "import_neighbours": f"""with {_RES}, b as (select src, dst from g union select dst, src from g),
s as (select distinct {_PATH} seed from part where p_partkey % 100 = 0),
o as (select seed, dst node, 1 depth from s join b on seed = src), t as (select distinct seed, b.dst node, 2 depth from o join b on o.node = b.src)
select seed, node, min(depth) depth from (select * from o union all select * from t) where seed <> node group by seed, node""",
    "callers_all": f"""with d as ({_SYM}), r as ({_REF}),
j as (select d.name def_name, d.path def_path, d.lang def_language, r.path, r.line, r.lang from d join r on lower(d.name) = lower(r.name) where d.path <> r.path)
select def_name, def_path, def_language, path, line, row_number() over (partition by def_name, def_path order by lang <> def_language, path, line) place from j qualify place <= 8""",
    "definitions_all": f"""with d as ({_SYM}), r as ({_REF}),
j as (select r.name ref_name, r.path ref_path, r.line ref_line, d.kind, d.path, d.line, d.lang <> r.lang o from r join d on lower(d.name) = lower(r.name) where d.path <> r.path)
select ref_name, ref_path, ref_line, kind, path, line, row_number() over (partition by ref_name, ref_path, ref_line order by o, case kind when 'class' then 0 when 'type' then 0 when 'function' then 1 when 'method' then 2 else 3 end, path, line) place from j qualify place <= 8""",
    "line_range_join": """with l as (select doc_id, unnest(string_split(text, chr(10))) b, unnest(range(1, len(string_split(text, chr(10))) + 1)) n from documents),
g as (select doc_id, unnest(range(1, (len(string_split(text, chr(10))) + 1)::bigint, 5)) s from documents)
select g.doc_id, s start_line, count(*) lines, sum(length(b))::bigint chars from l join g on l.doc_id = g.doc_id and n between s and s + 7 group by g.doc_id, s""",
    "related_scores": f"with {_SIGN} select source_path, path, score, rank from rel where rank <= 5",
    "affected_paths_all": f"""with {_SIGN}, c as (select distinct {_PATH} path from part),
n as (select unnest(flatten(list_transform(['test_' || st || '.py', st || '_test.py', st || '.test.py', st || '.spec.py'], lambda x: [d || '/' || x, 'tests/' || x, 'test/' || x]))) path from (select {_DIR} d, {_STEM} st from c)),
a as (select path, 0.95 k, 'changed test' z from c where {_TEST.replace('{x}', 'path')} union all select path, 0.85, 'named after a changed file' from n where path in (select path from f)
 union all select path, case when {_TEST.replace('{x}', 'path')} then 0.78 else 0.60 end, case when {_TEST.replace('{x}', 'path')} then 'related test' else 'related file' end from rel where rank <= 5 and source_path in (select path from c))
select path, max(k)::double confidence, string_agg(distinct z, '; ' order by z) reasons from a group by path""",
    "call_sites": r"""with l as (select doc_id, unnest(string_split(text, chr(10))) b, unnest(range(1, len(string_split(text, chr(10))) + 1)) line from documents)
select distinct doc_id, line, n as name from (select doc_id, line, unnest(regexp_extract_all(b, '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)) n from l) where lower(n) not in ('if', 'for', 'while', 'return', 'print', 'len')""",
    "cards_union": f"""with u as (select case when starts_with(name, 'test') then 'test' else 'symbol' end kind, name, path, line from ({_SYM}) union select 'usage', name, path, line from ({_REF}) union select 'import', {_NAME} || '.py', {_PATH}, p_partkey from part)
select kind, count(*) n, count(distinct name) names, round(sum(case kind when 'symbol' then 1.0 when 'test' then 0.95 when 'usage' then 0.72 else 0.88 end)::double, 4) weight from u group by kind""",
    "repo_map": f"""with s as ({_SYM}), t as (select path, count(*) n from s group by path order by n desc, path limit 20),
r as (select s.path, n, line, name from s join t using (path) qualify row_number() over (partition by s.path order by line) <= 25)
select path, n, string_agg(name, ',' order by line, name) as names from r group by path, n""",
}
