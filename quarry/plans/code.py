"""Plans of queries, gates, priors, candidate sources and rank rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import code
from ..operators import candidates as C
from . import retrieval as P
from .metadata import _STOPS
from .retrieval import read, toks
from .texts import _SYN, _idents

_PROMPT = "case p_partkey % 5 when 0 then concat(p_name, ' in python') when 1 then concat('x = ', p_brand, '(', p_size, ')') when 2 then concat('import ', p_brand, '\nfrom a import b\n', p_name) when 3 then concat('({[', p_name, ')]}}') else concat('delete ', p_name) end"


def _prompts(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.expr(_PROMPT).alias("prompt"))


def retrieval_plan(spark, sf):
    p = _prompts(spark, sf).withColumn("plan", code.plan(F.col("prompt")))
    of = lambda c: F.array_join(F.array_sort(F.col(f"plan.{c}")), " ")
    return p.select("p_partkey", of("fts").alias("fts"), of("ranking").alias("ranking"))


def prompt_gates(spark, sf):
    p = _prompts(spark, sf)
    return p.select("p_partkey", code.detected_language(F.col("prompt")).alias("detected"), code.import_lines(F.col("prompt")).cast("bigint").alias("import_lines"), code.allows_structural_rerank(F.col("prompt")).alias("structural"))


def bracket_prior(spark, sf):
    return _prompts(spark, sf).select("p_partkey", code.bracket_prior(F.col("prompt")).alias("penalty"))


def focus_lines(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", code.focus(F.col("text"), F.lit(1), (F.col("doc_id") % 12 + 1).cast("int"), 2).alias("f"))
    return d.select("doc_id", F.sha2("f.text", 256).alias("focus_sha256"), F.col("f.start_line").cast("bigint").alias("start_line"), F.col("f.end_line").cast("bigint").alias("end_line"))


def backfill(spark, sf):
    have = P.candidates(spark, sf, 3).select("query_id", "id", F.col("rank").alias("ord"))
    return P.shown(C.backfill(have, P.corpus_of(spark, sf), 8), "ord")


def dominant_language(spark, sf):
    lang = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"))
    c = P.candidates(spark, sf, 20).select("query_id", "id", "rank").join(lang, "id")
    return C.dominant_language(c)


def structural_signal(spark, sf):
    h = read(spark, sf, "part").select((F.col("p_partkey") % 50).alias("query_id"), F.concat("p_brand", F.lit("/"), F.col("p_size") % 7).alias("path"), F.expr("element_at(array('class','function','reference','import_target','importer','module'), cast(p_size % 6 as int) + 1)").alias("kind"), (F.col("p_partkey") % 48 + 1).alias("rank"))
    return C.structural_rerank(h).select("query_id", "path", F.round("boost", 6).alias("boost"), "best_rank")


def rank_profile(spark, sf):
    c, ranks = P.rank_tables(spark, sf)
    rows = c.select("query_id", "id", "rank", F.length("text").cast("double").alias("size"), F.round("score", 6).alias("score"))
    return P.shown(C.profile(rows, {"score": 1.0, "size": 0.5}, 10).filter("rank <= 10"), F.col("rank").cast("bigint").alias("rank"))


_ALL = (retrieval_plan, prompt_gates, bracket_prior, focus_lines, backfill, dominant_language, structural_signal, rank_profile)
QUERIES = {f.__name__: f for f in _ALL}

_Q = f"with p as (select p_partkey, {_PROMPT.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))} prompt from part)"
_PR = f"list_distinct({toks('prompt')})"
_GOOD = lambda x: f"list_filter({x}, lambda t: len(t) > 1 and not list_contains({_STOPS}, t) and not regexp_full_match(t, '[0-9]+'))"
_ID = _idents("prompt")
_CODE = f"""(contains(prompt, chr(10)) or len(regexp_extract_all(prompt, '[(){{}}\\[\\].:;=,"''`]')) >= 2)"""
_WIDE = lambda x: f"list_distinct(flatten(list_transform({x}, lambda t: list_concat([t], coalesce({_SYN}[t], [])))))"
_LOW = lambda x: f"case when len({_GOOD(x)}) > 0 then {_GOOD(x)} else {x} end"
SQL = {
    "retrieval_plan": f"""{_Q}, t as materialized (select p_partkey, {_CODE} c, {_PR} a, {_ID} i, {_GOOD(_ID)} k from p)
select p_partkey, array_to_string(list_sort(case when len(k) = 0 or not c then {_WIDE('a')} else list_distinct(list_concat({_LOW('a')}, k)) end), ' ') fts,
 array_to_string(list_sort(case when len(k) = 0 or not c then {_WIDE('list_distinct(list_concat(a, i))')} else list_distinct(list_concat(k, {_LOW('i')})) end), ' ') ranking from t""",
    "prompt_gates": f"""{_Q} select p_partkey, case when regexp_matches(lower(prompt), '(^|[^a-z0-9+#])python($|[^a-z0-9+#])') then 'py' else '' end detected,
 len(list_filter(string_split(prompt, chr(10)), lambda l: regexp_matches(l, '^\\s*(import |from |using |use |require |require\\(|require_relative |#include )')))::bigint import_lines, not {_CODE} structural from p""",
    "bracket_prior": f"""{_Q}, m as (select p_partkey, regexp_replace(prompt, '[^\\[\\](){{}}]', '', 'g') b from p),
c as (select p_partkey, i, case when substr(b, i, 1) in ('(', '[', '{{') then 1 else -1 end v from m, lateral (select unnest(range(1, length(b) + 1)) i)),
r as (select p_partkey, v, sum(v) over (partition by p_partkey order by i) n from c),
g as (select p_partkey, sum(case when v < 0 and n < 0 then 10 else 0 end) x, sum(v) n from r group by p_partkey)
select p.p_partkey, coalesce(x + 5 * abs(n), 0)::double penalty from p left join g on p.p_partkey = g.p_partkey""",
    "focus_lines": """with d as (select doc_id, string_split(text, chr(10)) l, doc_id % 12 + 1 c from documents), a as (select doc_id, l, least(c, len(l)) mid from d), r as (select doc_id, l, greatest(mid - 2, 1) lo, least(mid + 2, len(l)) hi from a)
select doc_id, sha256(array_to_string(l[lo:hi], chr(10))) focus_sha256, lo::bigint start_line, hi::bigint end_line from r""",
    "backfill": f"""with {P._CAND}, h as (select query_id, id, rank from c where rank <= 3), n as (select query_id, count(*) k, max(rank) m from h group by query_id),
f as (select n.query_id, dt.id, k, m, row_number() over (partition by n.query_id order by dt.id) r from n, dt where (n.query_id, dt.id) not in (select query_id, id from h))
select query_id, id doc_id, rank ord from h union all select query_id, id, m + r from f where r <= 8 - k""",
    "dominant_language": f"""with {P._CAND}, l as (select query_id, c.id, rank, lang from c join documents d on d.doc_id = c.id where rank <= 20),
r as (select *, row_number() over (partition by query_id, lang order by rank) n from l)
select query_id, lang as language from r qualify row_number() over (partition by query_id order by n desc, rank) = 1""",
    "structural_signal": """with h as (select p_partkey % 50 query_id, p_brand || '/' || p_size % 7 path, ['class','function','reference','import_target','importer','module'][p_size % 6 + 1] k, p_partkey % 48 + 1 rank from part),
g as (select query_id, path, sum(case k when 'class' then 1.25 when 'function' then 1.15 when 'reference' then 0.85 when 'import_target' then 1.0 when 'importer' then 0.7 else 0.95 end::double / (60 + rank)) s, min(rank) best_rank from h group by query_id, path)
select query_id, path, round(0.06::double * s / max(s) over (partition by query_id), 6) boost, best_rank from g""",
    "rank_profile": f"""with {P._CAND}, b as (select query_id, id, rank, length(text)::double z, round(score, 6) s from c where rank <= 10),
m as (select *, min(z) over w a, max(z) over w b2, min(s) over w x, max(s) over w y from b window w as (partition by query_id))
select query_id, id doc_id, row_number() over (partition by query_id order by case when y > x then (s - x) / (y - x) else 0 end + 0.5 * case when b2 > a then (z - a) / (b2 - a) else 0 end desc, rank) rank from m""",
}
