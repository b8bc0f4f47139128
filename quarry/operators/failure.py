"""Failure output: frames, locations, names; and the focus of repair packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .graph import is_dependency_path, is_test_path

#: Words of failure output that name nothing.
COMMON_WORDS = "actual assert asserted build case error errors exit expected fail failed failure file line none null panic status test tests trace traceback true false".split()
MAX_TERMS = 80
_PY = r'File "([^"]+)", line ([0-9]+)(?:, in ([A-Za-z_][A-Za-z0-9_]*))?'
_JS = r"at (?:([A-Za-z0-9_$.<>]+) \()?(?:file://)?([^()\s:]+):([0-9]+)(?::[0-9]+)?\)?"
_GO = r"^\s+(\S+\.go):([0-9]+)"
_AT = r"([A-Za-z0-9_./-]+\.[A-Za-z]{1,5}):([0-9]+)"


def numbered_lines(failures: DataFrame) -> DataFrame:
    """failures: failure_id, output -> failure_id, at, line."""
    return failures.select("failure_id", F.posexplode(F.split("output", "\n")).alias("at", "line"))


def frames(failures: DataFrame) -> DataFrame:
    """failure_id, at, path, line_no, function.  A Go frame's function stands on the line before its path."""
    lines = numbered_lines(failures).withColumn("before", F.lag("line").over(Window.partitionBy("failure_id").orderBy("at")))
    g = lambda p, k: F.regexp_extract("line", p, k)
    py, js, go, at = (F.col("line").rlike(p) for p in (_PY, _JS, _GO, _AT))
    name = F.when(py, g(_PY, 3)).when(go, F.regexp_extract("before", r"\.([A-Za-z0-9_]+)\(?[^.]*$", 1)).when(js, F.element_at(F.split(g(_JS, 1), r"\."), -1)).otherwise("")
    path = F.when(py, g(_PY, 1)).when(go, g(_GO, 1)).when(js, g(_JS, 2)).otherwise(g(_AT, 1))
    no = F.when(py, g(_PY, 2)).when(go, g(_GO, 2)).when(js, g(_JS, 3)).otherwise(g(_AT, 2))
    return lines.filter(py | js | go | at).select("failure_id", "at", text.normal_path(path).alias("path"), no.cast("int").alias("line_no"), name.alias("function")).dropDuplicates(["failure_id", "path", "line_no"])


def terms(failures: DataFrame) -> DataFrame:
    """failure_id, terms: at most MAX_TERMS: frame functions, quoted names, called names, error types, then words; first occurrences."""
    f = frames(failures).filter("function <> ''").groupBy("failure_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "function"))), lambda x: x["function"]).alias("functions"))
    o = failures.join(f, "failure_id", "left")
    every = lambda p, k=1: F.regexp_extract_all("output", F.lit(p), F.lit(k))
    quoted, called = every(r"['\"]([A-Za-z_][A-Za-z0-9_]{2,})['\"]"), every(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(")
    types, words = every(r"([A-Za-z]+(?:Error|Exception))"), every(r"([A-Za-z_][A-Za-z0-9_]{2,})")
    joint = F.filter(F.array_distinct(F.concat(F.coalesce("functions", F.array().cast("array<string>")), quoted, types, called, words)), lambda t: ~F.lower(t).isin(COMMON_WORDS))
    return o.select("failure_id", F.slice(joint, 1, MAX_TERMS).alias("terms"))


def path_tails(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def located(frames_: DataFrame, knowledge: DataFrame) -> DataFrame:
    """Of each frame the chunk that holds its line: longest shared path tail, exact before suffix, containing, nearest, smallest."""
    f = frames_.select("failure_id", "at", "line_no", "function", F.col("path").alias("f_path"), F.posexplode(path_tails(F.col("path"))).alias("tail_no", "tail"))
    k = knowledge.select("path", "start_line", "end_line", F.explode(path_tails(F.col("path"))).alias("tail"))
    j = f.join(k, "tail").filter((F.col("tail") == F.col("path")) | (F.col("tail_no") == 0))
    inside = F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    w = Window.partitionBy("failure_id", "at").orderBy("tail_no", (F.col("path") != F.col("f_path")).cast("int"), (~inside).cast("int"), F.abs(F.col("start_line") - F.col("line_no")), F.col("end_line") - F.col("start_line"), "path", "start_line")
    return j.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth", "tail", "tail_no")


def frame_rank(frames_: DataFrame) -> DataFrame:
    """30 and more for later frames, +8 with a function, +15 source, -10 test, -30 dependency."""
    place = F.row_number().over(Window.partitionBy("failure_id").orderBy("at")) - 1
    rank = 30 + F.least(place, F.lit(20)) + F.when(F.col("function") != "", 8).otherwise(0) + F.when(is_test_path(F.col("path")), -10).otherwise(15) - F.when(is_dependency_path(F.col("path")), 30).otherwise(0)
    return frames_.withColumn("frame_rank", rank)


def symbol_rank(terms_: DataFrame, symbols: DataFrame, frames_: DataFrame) -> DataFrame:
    """By failure and symbol: +40 exact, +18 part of the name, +8 in the path, +12 in a frame's file, -25 test file, -15 test name."""
    t = terms_.select("failure_id", F.explode("terms").alias("term"))
    s = symbols.select("name", "kind", "path", "line", F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), text.identifier_tokens(F.col("name"))))).alias("key"))
    j = t.withColumn("key", F.explode(F.array_distinct(F.concat(F.array(F.lower("term")), text.identifier_tokens(F.col("term")))))).join(s, "key")
    files = frames_.select("failure_id", F.explode(path_tails(F.col("path"))).alias("path")).distinct().withColumn("framed", F.lit(12))
    score = F.when(F.lower("term") == F.lower("name"), 40).otherwise(18) + F.when(F.contains(F.lower("path"), F.lower("term")), 8).otherwise(0)
    g = j.withColumn("score", score).groupBy("failure_id", "name", "kind", "path", "line").agg(F.max("score").alias("score"))
    out = g.join(files, ["failure_id", "path"], "left")
    return out.withColumn("score", F.col("score") + F.coalesce("framed", F.lit(0)) - F.when(is_test_path(F.col("path")), 25).otherwise(0) - F.when(F.lower("name").startswith("test"), 15).otherwise(0)).drop("framed")
