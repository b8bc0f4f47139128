"""Context packs: receipts, selection, byte budget, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import is_dependency_path, is_test_path

BUDGET, LEAST, MOST = 12 << 10, 512, 200 << 10
MARGIN = {"debug": 0.60, "refactor": 0.60, "test": 0.60, "review": 0.60}
#: What each mode adds to a query.
MODES = {"debug": "error failure exception stack trace", "refactor": "definition usage caller interface", "test": "test fixture assertion expected", "review": "change impact caller test", "docs": "readme documentation usage example"}


def limit_of(value: int, fallback: int = 5) -> int:
    """L01."""
    return fallback if value <= 0 else min(value, 100)


def budget_of(value: int) -> int:
    return BUDGET if value <= 0 else min(max(value, LEAST), MOST)


def expand_mode(query: str, mode: str) -> str:
    """words of the mode that the query lacks follow it."""
    own = set(query.lower().split())
    return " ".join([query, *(w for w in MODES.get(mode, "").split() if w not in own)]).strip()


def mode_query(query: Column, mode: Column) -> Column:
    """F25 by row: expand_mode as a column."""
    known = F.create_map(*[F.lit(x) for k, v in MODES.items() for x in (k, v)])
    own = F.split(F.lower(query), r"\s+")
    more = F.filter(F.split(F.coalesce(F.try_element_at(known, mode), F.lit("")), " "), lambda w: (w != "") & ~F.array_contains(own, w))
    return F.trim(F.array_join(F.concat(F.array(query), more), " "))


def receipts(snippets: DataFrame, queries: DataFrame) -> DataFrame:
    """K02.  snippets: query_id, id, rank, path, topic, text, score (lower is better).  Adds matched, evidence, reasons, confidence.

    .62 where two or more query tokens meet the snippet, .58 for one, else .55."""
    q = queries.select("query_id", text.drop_low_signal(text.primary_tokens(F.col("text"))).alias("q"))
    s = snippets.join(q, "query_id").withColumn("matched", F.array_intersect("q", text.primary_tokens(F.concat_ws(" ", "topic", "text"))))
    n = F.size("matched")
    evidence = F.when(n >= 2, F.slice("matched", 1, 8)).otherwise(F.array().cast("array<string>"))
    reasons = F.array_compact(F.array(F.lit("ranked match"), F.when(n > 0, F.lit("matched query tokens")), F.when(is_test_path(F.col("path")), F.lit("test"))))
    return s.withColumn("evidence", evidence).withColumn("reasons", reasons).withColumn("confidence", F.when(n >= 2, 0.62).when(n == 1, 0.58).otherwise(0.55)).drop("q")


#: Rendered bytes of a section besides its path, content and note; of a gap between sections; the least that a cut content keeps.
FRAME, GAP, PIECE = len("### \n```\n\n```"), len("\n\n"), 80
MARKER = "\n[truncated]"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once; a long text is cut in steps."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(content: Column, most: Column) -> Column:
    """the first `most` bytes: up to a line break beyond the half, else up to a whole character."""

    def whole(raw: Column) -> Column:
        """Without a last character that isn't all there."""
        return F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "\ufffd$", ""))

    def broken(piece: Column) -> Column:
        line = F.substring_index(piece, "\n", -1)
        at = F.octet_length(piece) - F.octet_length(line) - 1
        return F.when(at > F.floor(most / 2), F.left(piece, F.length(piece) - F.length(line) - 1)).otherwise(piece)

    first = F.substring(F.encode(content, "UTF-8"), F.lit(1), most).cast("string")
    return F.when(F.octet_length(content) <= most, content).otherwise(_let(_let(first, whole), broken))


def note(reasons: Column, evidence: Column) -> Column:
    """A receipt as it is rendered under its snippet."""
    told = F.array_compact(F.array(F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")), F.when(F.size(evidence) > 0, F.array_join(evidence, ", "))))
    return F.when(F.size(told) > 0, F.concat(F.lit("\n> "), F.array_join(told, "; "))).otherwise("")


def select(found: DataFrame, limit: int = 5, mode: str = "") -> DataFrame:
    """Of each query's receipted snippets those worth keeping, with their place.

    Kept are the first; those with evidence or a confidence of .65; those within .08 of the first's score; and lexical ones within the mode's
    margin, as long as fewer than two with evidence were kept before."""
    most, margin = limit_of(limit), MARGIN.get(mode, 0.40)
    w = Window.partitionBy("query_id").orderBy("rank")
    sure = (F.size("evidence") > 0) | (F.col("confidence") >= 0.65)
    top = found.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)
    top = top.withColumn("best", F.first("score").over(w)).withColumn("sure", sure)
    strong = F.coalesce(F.sum((F.col("sure") & (F.col("nth") > 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lexical = (F.size("matched") > 0) & (F.col("score") <= F.col("best") + margin) & (strong < 2)
    kept = top.withColumn("kept", (F.col("nth") == 1) | F.col("sure") | (F.col("score") <= F.col("best") + 0.08) | lexical).filter("kept")
    return kept.withColumn("place", F.row_number().over(w)).drop("nth", "best", "sure", "kept")


def fit(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The largest pack whose rendering has at most `budget` bytes.  rows: query_id, place, path, text, note; adds content, truncated, receipt, used_bytes.

    Sizes add up, so the snippets that fit as a whole are those up to a place; the next one is cut to what is left, if that is PIECE bytes or
    more.  Of a pack of one snippet the note goes before the content is cut below that.  used_bytes is the rendering's size up to that place."""
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    frame = size(F.col("path")) + FRAME + F.when(F.col("place") > 1, GAP).otherwise(0)
    w = Window.partitionBy("query_id").orderBy("place")
    r = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("frame", frame).withColumn("full", frame + size(F.col("text")) + size(F.col("note")))
    r = r.withColumn("used_bytes", F.sum("full").over(w)).withColumn("before", F.col("used_bytes") - F.col("full"))
    r = r.withColumn("whole", F.col("used_bytes") <= budget).withColumn("last", F.col("whole") | (F.col("before") <= budget))
    noted = budget - F.col("before") - F.col("frame") - size(F.col("note")) - len(MARKER)
    bare = budget - F.col("before") - F.col("frame")
    first = F.col("place") == 1
    how = F.when(F.col("whole"), "whole").when(noted >= PIECE, "cut").when(first & (size(F.col("text")) <= bare), "bare").when(first, "bare cut")
    r = r.withColumn("how", how).filter(F.col("last") & F.col("how").isNotNull())
    most = F.greatest(F.when(F.col("how") == "cut", noted).otherwise(bare - len(MARKER)), F.lit(0))
    trimmed = F.col("how").isin("cut", "bare cut")
    content = F.when(trimmed, F.concat(cut(F.col("text"), most), F.lit(MARKER))).otherwise(F.col("text"))
    r = r.withColumn("content", content).withColumn("truncated", trimmed).withColumn("receipt", F.col("how").isin("whole", "cut") & (F.col("note") != ""))
    r = r.withColumn("note", F.when(F.col("receipt"), F.col("note")).otherwise("")).withColumn("used_bytes", (F.col("before") + F.col("frame") + size(F.col("content")) + size(F.col("note"))).cast("int"))
    return r.filter((F.col("used_bytes") <= budget) | first).drop("frame", "full", "before", "whole", "last", "how", "text")


def pack(found: DataFrame, limit: int = 5, budget: int = BUDGET, mode: str = "") -> DataFrame:
    """Selection, then the byte budget."""
    kept = select(found, limit, mode)
    notes = note(F.col("reasons"), F.col("evidence")) if "reasons" in found.columns else F.lit("")
    rows = kept.select("query_id", "place", "id", "path", "text", notes.alias("note"), F.size("matched").alias("matched"), F.size("evidence").alias("evidence"))
    return fit(rows, budget_of(budget)).select("query_id", "place", "id", "path", "content", "note", "truncated", "matched", "evidence", "receipt", "used_bytes")


def half_up(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def quality(rows: DataFrame) -> DataFrame:
    """K07, A15.  rows: query_id, path, evidence (a number), definitions, references, receipt, truncated.  query_id, score, grade."""
    g = rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.sum(F.col("receipt").cast("int")).alias("receipts"), F.sum("definitions").alias("definitions"), F.sum("references").alias("refs"),
        F.count_distinct("path").alias("paths"), F.sum("evidence").alias("evidence"), F.max("truncated").alias("truncated"), F.sum(is_test_path(F.col("path")).cast("int")).alias("tests"),
        F.sum((is_dependency_path(F.col("path")) & ~is_test_path(F.col("path"))).cast("int")).alias("dependencies"),
    )
    g = g.withColumn("sources", F.col("n") - F.col("tests") - F.col("dependencies"))
    n = F.col("n").cast("double")
    s = (
        F.lit(0.18) + 0.18 * half_up(text.capped_ratio(F.col("receipts"), n)) + 0.12 * text.capped_ratio(F.col("definitions").cast("double"), F.lit(2.0)) + 0.10 * text.capped_ratio(F.col("refs").cast("double"), F.lit(2.0))
        + 0.12 * text.capped_ratio(F.col("tests").cast("double"), F.lit(1.0)) + 0.10 * half_up(text.capped_ratio(F.col("paths"), n)) + 0.14 * text.capped_ratio(half_up(F.col("evidence") / n), F.lit(2.0))
        + F.when(~F.col("truncated"), 0.08).otherwise(0.0) - F.when((F.col("dependencies") > 0) & (F.col("dependencies") >= F.col("sources")), 0.10).otherwise(0.0)
    )
    return g.withColumn("raw", text.clamp(s, 0.0, 1.0)).select("query_id", half_up(F.col("raw") + 1e-9).alias("score"), text.grade(F.col("raw")).alias("grade"))


def render(packed: DataFrame, quality_: DataFrame | None = None) -> DataFrame:
    """Markdown by query: each snippet with its note; with quality_ (of quality()) a line on top where there is anything to say."""
    part = F.concat(F.lit("### "), F.coalesce("path", F.lit("")), F.lit("\n```\n"), "content", F.lit("\n```"), "note")
    out = packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("markdown"))
    if quality_ is None:
        return out
    told = F.when(F.col("score") > 0, F.format_string("Quality: %s (%.2f)\n\n", "grade", "score")).otherwise("")
    return out.join(quality_.select("query_id", "score", "grade"), "query_id", "left").select("query_id", F.concat(F.coalesce(told, F.lit("")), "markdown").alias("markdown"))
