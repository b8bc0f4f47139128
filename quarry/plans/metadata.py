"""Metadata search over tables derived from `part`, and types that documents name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fixed import STOP_TOKENS
from ..operators import metadata as M
from . import retrieval as P
from .graph import references, symbols
from .retrieval import read
from .texts import _idents


def _asked(spark, sf):
    return read(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("query_id"), F.expr("element_at(array('red bolt', 'small Brand#1', 'BlueWidget', 'steel_gear', 'class green'), r_regionkey + 1)").alias("text"))


def _symbols(spark, sf):
    return symbols(spark, sf).withColumn("signature", F.concat_ws(" ", "kind", "name", "path")).withColumn("docstring", F.lit(""))


def symbol_search(spark, sf):
    s = M.search(_symbols(spark, sf), _asked(spark, sf), M.SYMBOL_POINTS, 10)
    return s.select("query_id", "name", "path", "line", F.col("score").cast("bigint").alias("score"), "rank")


def card_search(spark, sf):
    c = _symbols(spark, sf).select(F.lit("symbol").alias("kind"), "name", "path", "line", F.col("signature").alias("summary"))
    u = references(spark, sf).select(F.lit("usage").alias("kind"), "name", "path", "line", F.lit("").alias("summary"))
    return M.search_cards(c.unionAll(u), _asked(spark, sf), 10).select("query_id", "kind", "name", "path", "line", "score", "rank")


def exact_identifier_boost(spark, sf):
    q = P.queries_of(spark, sf).withColumn("text", F.concat(F.lit("import "), "text"))
    return P.shown(M.exact_identifiers(q, P.candidates(spark, sf)), F.round("boost", 6).alias("boost"))


def type_mentions(spark, sf):
    t = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return M.mentioned_types(t).groupBy("name").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (symbol_search, card_search, exact_identifier_boost, type_mentions)}

_ASK = "select r_regionkey::bigint query_id, ['red bolt', 'small Brand#1', 'BlueWidget', 'steel_gear', 'class green'][r_regionkey + 1] q from region"
_SYM = "select split_part(p_name, ' ', 1) n, ['class','function','method','type'][p_size % 4 + 1] k, 'a/' || p_brand p, p_partkey line from part"
SQL = {
    "symbol_search": f"""with a as ({_ASK}), t as (select query_id, unnest({_idents('q')}) t from a), s as (select n, k, p, line, k || ' ' || n || ' ' || p sig from ({_SYM})),
x as (select query_id, n, p, line, case when lower(n) = t then 10 when contains(lower(n), t) then 6 when contains(lower(p), t) then 3 when contains(lower(sig), t) then 2 else 0 end s from s, t),
g as (select query_id, n, p, line, sum(s)::bigint score from x group by all having sum(s) > 0)
select query_id, n as name, p as path, line, score, row_number() over (partition by query_id order by score desc, p, line, n) rank from g qualify rank <= 10""",
    "card_search": f"""with a as ({_ASK}), t as (select query_id, unnest({_idents('q')}) t from a),
c as (select 'symbol' kind, n, p, line, {_idents("n || ' ' || p || ' ' || k || ' ' || n || ' ' || p")} ts from ({_SYM})
 union all select 'usage', upper(split_part(p_name, ' ', 1)), 'b/' || p_type, p_partkey, {_idents("upper(split_part(p_name, ' ', 1)) || ' b/' || p_type")} from part),
h as (select query_id, kind, n, p, line, count(*) h from t join c on list_contains(ts, t) group by all),
g as (select *, round(case kind when 'symbol' then 1.05 else 0.72 end + 0.08 * h::double, 6) score from h)
select query_id, kind, n as name, p as path, line, score, row_number() over (partition by query_id order by score desc, p, line, n, kind) rank from g qualify rank <= 10""",
    "type_mentions": r"""with t as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9]{2,})', 1))) n from documents)
select n as name, count(*) documents from t where n not in ('API','CSS','CSV','HTML','HTTP','HTTPS','JSON','SQL','TODO','URL','UUID','XML','True','False','None') group by n""",
}
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_TOKENS) + "]"
_GOODI = lambda x: f"list_filter({_idents(x)}, lambda t: not list_contains({_STOPS}, t) and not regexp_full_match(t, '[0-9]+'))"
SQL["exact_identifier_boost"] = f"""with {P._CAND}, qi as (select query_id, unnest({_GOODI('q_text')}) t from q),
ct as (select query_id, id, count(*) over (partition by query_id) n, {_idents('text')} ts from c),
j as (select query_id, id, n, t, count(*) over (partition by query_id, t) df from ct join qi using (query_id) where list_contains(ts, t)),
r as (select query_id, id, sum(ln(1 + (n + 1) / (df + 1))) raw from j group by query_id, id)
select query_id, id doc_id, round(0.08 * raw / max(raw) over (partition by query_id), 6) boost from r"""
# BM25 over each query's candidates, on identifier tokens with repeats.
_ALLI = _idents("text").removeprefix("list_distinct(")[:-1]
SQL["candidate_bm25"] = f"""with {P._CAND}, ct as materialized (select query_id, id, {_ALLI} ts from c),
st2 as (select query_id, count(*) n, avg(len(ts)) a from ct group by query_id),
tf as (select query_id, id, t, count(*) tf, any_value(l) l from (select query_id, id, len(ts) l, unnest(ts) t from ct) semi join qk using (query_id, t) group by query_id, id, t),
d2 as (select *, count(*) over (partition by query_id, t) df from tf),
r as (select query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / a))) raw from d2 join st2 using (query_id) group by query_id, id)
select query_id, id doc_id, round(0.08 * raw / max(raw) over (partition by query_id), 6) bm25 from r"""
