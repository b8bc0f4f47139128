"""Packs, distances, chunks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import distance, text
from ..operators import failure, packs
from ..operators import retrieval as R
from ..sources import chunks, shared
from ..sources.files import is_text
from ..streaming import incremental as S
from . import retrieval as P
from .retrieval import read


def _found(spark, sf):
    c = P.candidates(spark, sf, 10).withColumn("score", F.round(1 / (1 + F.col("score")), 6))
    return packs.receipts(c, P.queries_of(spark, sf))


def receipts(spark, sf):
    return P.shown(_found(spark, sf), F.size("matched").cast("bigint").alias("matched"), F.size("evidence").cast("bigint").alias("evidence"), "confidence")


def context_pack(spark, sf):
    return packs.pack(_found(spark, sf), 5, 4096).select("query_id", "place", F.col("id").alias("doc_id"), "truncated", "used_bytes")


def quality_score(spark, sf):
    """K07 over fixed pack rows: parts as snippets of ten to a pack."""
    p = read(spark, sf, "part")
    path = F.expr("case p_partkey % 4 when 0 then concat('tests/', p_brand, '.py') when 1 then concat('vendor/', p_brand, '.py') else concat('src/', p_brand, '.py') end")
    rows = p.select((F.col("p_partkey") % 200).alias("query_id"), path.alias("path"), (F.col("p_size") % 4).alias("evidence"), (F.col("p_size") % 2).alias("definitions"), (F.col("p_size") % 3 % 2).alias("references"), (F.col("p_size") % 5 > 0).alias("receipt"), (F.col("p_size") == 50).alias("truncated"))
    return packs.quality(rows)


def qnd_topk(spark, sf):
    """F18 over the ten best candidates of each query, nearest first."""
    q = P.queries_of(spark, sf).select("query_id", F.col("text").alias("q"))
    c = P.candidates(spark, sf, 10).join(q, "query_id").withColumn("qnd", F.round(distance.qnd()(F.col("q"), F.col("text")), 6))
    return P.shown(R.top_k(c.drop("rank"), 5, F.asc("qnd"), F.asc("id")), "rank", "qnd")


def lcs_overlap(spark, sf):
    q = P.queries_of(spark, sf).select("query_id", F.col("text").alias("q"))
    c = P.candidates(spark, sf, 5).join(q, "query_id")
    return P.shown(c, F.round(distance.lcs_ratio(text.tokens(F.col("q")), text.tokens(F.col("text"))), 6).alias("lcs"))


def byte_chunks(spark, sf):
    d = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("txt").alias("language"), F.col("text").alias("content"))
    return chunks.chunk(d, 1024).select(F.col("path").cast("bigint").alias("doc_id"), "seq", "start_line", "end_line", F.octet_length("content").alias("bytes"), "content_hash")


def text_sniff_filter(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    noisy = d.withColumn("content", F.when(F.col("doc_id") % 9 == 0, F.concat("content", F.unhex(F.lit("0001")))).otherwise(F.col("content")))
    return noisy.select("doc_id", is_text(F.col("content")).alias("is_text"))


def _frames_of(p):
    out = F.concat(F.lit('Traceback (most recent call last):\n  File "src/'), "p_brand", F.lit('.py", line '), F.col("p_size").cast("string"), F.lit(", in run\n  File \"tests/test_x.py\", line 3, in test_x\nValueError: bad 'cache_key'"))
    f = failure.frame_rank(failure.frames(p.select(F.col("p_partkey").alias("failure_id"), out.alias("output"))))
    return f.select("failure_id", "at", "path", "line_no", "function", F.col("frame_rank").cast("bigint").alias("frame_rank"))


def repair_frames_all(spark, sf):
    """X12, K08 over failure outputs made of every part."""
    return _frames_of(read(spark, sf, "part"))


def stream_incremental_counts(spark, sf):
    """Hourly counts by type, drained from a stream and merged batch by batch; the final table."""
    home = shared.fresh(spark, "stream")
    sink = S.Upserts(spark, f"{home}/table", ["hour", "event_type"], "hour timestamp, event_type string, n bigint")
    S.drain(S.hourly_counts(S.table_stream(spark, sf, "events"), "3650 days"), f"{home}/checkpoint", sink)
    return sink.table().select(F.date_format("hour", "yyyy-MM-dd HH:00").alias("hour"), "event_type", "n")


_ALL = (receipts, context_pack, quality_score, qnd_topk, lcs_overlap, byte_chunks, text_sniff_filter, repair_frames_all, stream_incremental_counts)
QUERIES = {f.__name__: f for f in _ALL}

_STOP = P.toks("q_text")
_BRAND = "case p_partkey % 4 when 0 then 'tests/' || p_brand || '.py' when 1 then 'vendor/' || p_brand || '.py' else 'src/' || p_brand || '.py' end"


def _stop() -> str:
    from ..functions.fixed import STOP_TOKENS

    return "[" + ", ".join(f"'{w}'" for w in STOP_TOKENS) + "]"


SQL = {
    "receipts": f"""with {P._CAND},
k as (select query_id, list_filter(qt, lambda t: not list_contains({_stop()}, t) and not regexp_full_match(t, '[0-9]+')) g, qt from q),
m as (select c.query_id, c.id, len(list_intersect(case when len(g) > 0 then g else qt end, {P.toks("topic || ' ' || text")})) n from c join k using (query_id) where rank <= 10)
select query_id, id doc_id, n::bigint matched, case when n >= 2 then least(n, 8) else 0 end::bigint evidence, case when n >= 2 then 0.62 when n = 1 then 0.58 else 0.55 end::double confidence from m""",
    "quality_score": f"""with r as (select p_partkey % 200 query_id, {_BRAND} path, p_size % 4 e, p_size % 2 d, p_size % 3 % 2 f, p_size % 5 > 0 rc, p_size = 50 tr from part),
g as (select query_id, count(*)::double n, sum(rc::int) rc, sum(d) d, sum(f) f, count(distinct path) p, sum(e) e, max(tr) tr, sum((path like 'tests/%')::int) t, sum((path like 'vendor/%')::int) v from r group by query_id),
s as (select query_id, least(greatest(0.18::double + 0.18::double * floor(least(rc / n, 1) * 100 + 0.5) / 100 + 0.12::double * least(d / 2.0::double, 1) + 0.10::double * least(f / 2.0::double, 1) + 0.12::double * least(t, 1) + 0.10::double * floor(least(p / n, 1) * 100 + 0.5) / 100
 + 0.14::double * least(floor(e / n * 100 + 0.5) / 100 / 2, 1) + case when not tr then 0.08::double else 0 end - case when v > 0 and v >= n - t - v then 0.10::double else 0 end, 0), 1) x from g)
select query_id, floor((x + 1e-9) * 100 + 0.5) / 100 score, case when x >= 0.75 then 'strong' when x >= 0.55 then 'usable' when x >= 0.35 then 'thin' else 'weak' end grade from s""",
    "text_sniff_filter": "select doc_id, doc_id % 9 <> 0 or strlen(text) >= 8192 is_text from documents",
    "repair_frames_all": """with p as (select p_partkey k, p_brand b, p_size s from part)
select k failure_id, 1 as "at", 'src/' || b || '.py' path, s line_no, 'run' as function, 53::bigint frame_rank from p union all select k, 2, 'tests/test_x.py', 3, 'test_x', 29 from p""",
    "stream_incremental_counts": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') as hour, event_type, count(*) n from events group by 1, 2",
}
