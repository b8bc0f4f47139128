"""Import edges, neighbours, definitions and callers, related files, affected tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import ranked


def is_test_path(path: Column) -> Column:
    """P09."""
    return path.rlike(r"(^|/)tests?/|(^|/)test_|_test\.|\.test\.|\.spec\.|_spec\.")


def is_dependency_path(path: Column) -> Column:
    return path.rlike(r"(^|/)(node_modules|vendor|third_party|site-packages|dist|build)/")


def suffixes(path: Column) -> Column:
    """Every tail of a path that begins at a segment; turns `ends with` joins into equi-joins."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve_imports(edges: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """J05.  edges: path, line, candidates (ordered list of paths); files: path.  `key` and line tell edges apart.

    Adds target_path: of the first candidate that meets any file the best one: exact
    before suffix, no test, shorter, then by name; null where none is met."""
    c = edges.select(*dict.fromkeys((key, "path", "line")), F.posexplode("candidates").alias("cand_no", "key"))
    f = files.select(F.col("path").alias("target"), F.explode(suffixes(F.col("path"))).alias("key"))
    found = c.join(f, "key").filter(F.col("target") != F.col("path"))
    order = F.struct("cand_no", (F.col("key") != F.col("target")).cast("int").alias("by_suffix"), is_test_path(F.col("target")).cast("int").alias("test"), F.length("target").alias("size"), "target")
    best = found.groupBy(key, "line").agg(F.min_by("target", order).alias("target_path"))
    return edges.drop("candidates").join(best, [key, "line"], "left")


def file_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """J06.  edges: src, dst; path, other, direction: what these files bring in, and what brings them in."""
    out = edges.select(F.col("src").alias("path"), F.col("dst").alias("other"), F.lit("out").alias("direction"))
    back = edges.select(F.col("dst").alias("path"), F.col("src").alias("other"), F.lit("in").alias("direction"))
    return out.unionAll(back).join(paths.select("path").distinct(), "path", "left_semi")


#: What a relation adds to a graph candidate's priority of 50.
PRIORITIES = {"incoming": 15, "symbol_reference": 18, "symbol_definition": 22, "dependent_type": 26}


def priority(path: Column, relation: Column) -> Column:
    """And 20 for a test, -30 for a dependency."""
    known = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    return 50 + F.coalesce(F.try_element_at(known, relation), F.lit(0)) + F.when(is_test_path(path), 20).otherwise(0) - F.when(is_dependency_path(path), 30).otherwise(0)


def merge_candidates(rows: DataFrame, limit: int, key: str = "path") -> DataFrame:
    """U06.  rows: query_id, key, path, relation, reasons, evidence, confidence.  One row a key: greatest priority and confidence, all reasons and evidence; the first `limit` by priority, then path."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    g = rows.withColumn("priority", priority(F.col("path"), F.col("relation"))).groupBy(*dict.fromkeys(("query_id", key, "path"))).agg(F.max("priority").alias("priority"), F.max("confidence").alias("confidence"), every("reasons").alias("reasons"), every("evidence").alias("evidence"))
    return ranked(g, F.desc("priority"), F.asc("path"), F.asc(key)).filter(F.col("rank") <= limit)


#: Rows of the graph that a pack takes, by mode; one in others.
ROOM = {"debug": 2, "refactor": 2, "test": 2, "review": 2, "docs": 0}


def room_of(mode: Column, limit: int) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ROOM.items() for x in kv])
    return F.least(F.coalesce(F.try_element_at(known, mode), F.lit(1)), F.lit(limit - 1))


def merge_into(found: DataFrame, candidates: DataFrame, limit: int = 5, room: Column | int = 1) -> DataFrame:
    """K03, for many queries at once: the best hit, then up to `room` rows of the graph with one to a path, then the other hits; `limit` in all.

    found: query_id, id, rank, path, text, topic, score, matched, reasons, evidence, confidence.  candidates: query_id, id, path, text, topic, place
    (their order, from 1), reasons, evidence, confidence; room may be a column of found.  A candidate of a path that is in already adds its receipt to that row, as
    long as there is room; one that is a hit as well keeps the hit's score and both receipts.  The result has found's columns, rank is the new place."""
    every = lambda *c: F.array_distinct(F.flatten(F.array(*c)))
    none = F.array().cast("array<string>")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))
    lead = best.filter("nth = 1").select("query_id", F.col("path").alias("l_path"), (F.lit(room) if isinstance(room, int) else room).alias("room"))
    c = candidates.join(lead, "query_id")
    c = c.withColumn("again", F.row_number().over(Window.partitionBy("query_id", "path").orderBy("place", "id")))
    c = c.withColumn("fresh", (F.col("again") == 1) & ~F.col("path").eqNullSafe(F.col("l_path")))
    c = c.withColumn("taken", F.sum(F.col("fresh").cast("int")).over(Window.partitionBy("query_id").orderBy("place", "id")))
    c = c.withColumn("added", F.col("fresh") & (F.col("taken") <= F.col("room")))
    seen = c.filter((F.col("taken") < F.col("room")) | F.col("added"))  # what comes before the room is used up
    receipts_ = seen.groupBy("query_id", F.col("path").alias("r_path")).agg(
        F.array_sort(F.collect_list(F.struct("place", "reasons", "evidence"))).alias("r"), F.max("confidence").alias("r_confidence")
    )
    receipts_ = receipts_.select("query_id", "r_path", F.flatten(F.transform("r", lambda x: x["reasons"])).alias("r_reasons"), F.flatten(F.transform("r", lambda x: x["evidence"])).alias("r_evidence"), "r_confidence")
    own = c.filter("added").select("query_id", "id", "path", "text", "topic", "place")
    hits = best.select(F.col("query_id").alias("h_query"), F.col("id").alias("h_id"), "nth", F.col("score").alias("h_score"), F.col("matched").alias("h_matched"), F.col("reasons").alias("h_reasons"), F.col("evidence").alias("h_evidence"), F.col("confidence").alias("h_confidence"))
    graph = own.join(hits, (F.col("query_id") == F.col("h_query")) & (F.col("id") == F.col("h_id")), "left")
    left = best.join(own.select(F.col("query_id").alias("o_query"), F.col("id").alias("o_id")), (F.col("query_id") == F.col("o_query")) & (F.col("id") == F.col("o_id")), "left_anti")
    out = left.select("query_id", "id", "path", "text", "topic", "score", "matched", "reasons", "evidence", "confidence", F.when(F.col("nth") == 1, 0).otherwise(2).alias("turn"), F.col("nth").alias("at"))
    of_graph = graph.select("query_id", "id", "path", "text", "topic", F.coalesce("h_score", F.lit(0.0)).alias("score"), F.coalesce("h_matched", none).alias("matched"), F.coalesce("h_reasons", none).alias("reasons"), F.coalesce("h_evidence", none).alias("evidence"), F.coalesce("h_confidence", F.lit(0.0)).alias("confidence"), F.lit(1).alias("turn"), F.col("place").alias("at"))
    u = out.unionByName(of_graph).join(receipts_.withColumnRenamed("query_id", "r_query"), (F.col("query_id") == F.col("r_query")) & F.col("path").eqNullSafe(F.col("r_path")) & (F.col("turn") < 2), "left")
    u = u.withColumn("reasons", every(F.col("reasons"), F.coalesce("r_reasons", none))).withColumn("evidence", every(F.col("evidence"), F.coalesce("r_evidence", none)))
    u = u.withColumn("confidence", F.greatest("confidence", F.coalesce("r_confidence", F.lit(0.0))))
    placed = u.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "at", "id"))).filter(F.col("rank") <= limit)
    return placed.select("query_id", "id", "rank", "path", "topic", "text", "score", "matched", "evidence", "reasons", "confidence", (F.col("turn") == 1).alias("of_graph"))


def card_hits(cards: DataFrame, snippets: DataFrame) -> DataFrame:
    """J11.  cards: path, line, rank, score; by snippet (path, start_line, end_line) the best rank and the best score, times 1.15."""
    return in_ranges(cards, snippets).groupBy("path", "start_line", "end_line").agg(F.min("rank").alias("rank"), (1.15 * F.max("score")).alias("score"))


def merge_commands(groups: list[DataFrame]) -> DataFrame:
    """U08.  groups: command, confidence, in order of precedence; a command's first group wins, the best confidence in it."""
    tagged = reduce(DataFrame.unionAll, [g.select("command", "confidence", F.lit(k).alias("group_no")) for k, g in enumerate(groups)])
    return tagged.groupBy("command").agg(F.min(F.struct("group_no", -F.col("confidence"))).alias("b")).select("command", F.col("b.group_no").alias("group_no"), (-F.col("b.col2")).alias("confidence"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """J08.  edges: src, dst; seeds: seed.  seed, node, depth (least), over edges either way; the seed itself is left out."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    layers = []
    for k in range(1, depth + 1):
        front = front.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.lit(k).alias("depth")).distinct()
        layers.append(front)
    found = reduce(DataFrame.unionAll, layers).groupBy("seed", "node").agg(F.min("depth").alias("depth"))
    return found.filter(F.col("seed") != F.col("node"))


def kind_order(kind: Column) -> Column:
    return F.when(kind.isin("class", "type", "interface", "struct"), 0).when(kind == "function", 1).when(kind == "method", 2).otherwise(3)


def _first(rows: DataFrame, limit: int, *order) -> DataFrame:
    """What can be among the first `limit` rows of a key once one path is left out: of each language 2 * limit rows, at most `limit` of a path."""
    n = F.row_number().over(Window.partitionBy("key", "language", "path").orderBy(*order))
    r = rows.filter("path is not null").withColumn("_n", n).filter(F.col("_n") <= limit)
    n = F.row_number().over(Window.partitionBy("key", "language").orderBy(*order))
    return r.withColumn("_n", n).filter(F.col("_n") <= 2 * limit).drop("_n")


def callers(definitions: DataFrame, references: DataFrame, limit: int = 8) -> DataFrame:
    """J03.  definitions: name, language, path; references: name, language, path, line.  By definition at most `limit` call sites elsewhere, of its language first."""
    d = definitions.select(F.lower("name").alias("key"), F.col("name").alias("def_name"), F.col("language").alias("def_language"), F.col("path").alias("def_path"))
    r = references.select(F.lower("name").alias("key"), "language", "path", "line")
    j = d.join(_first(r, limit, "path", "line"), "key").filter(F.col("path") != F.col("def_path"))
    w = Window.partitionBy("def_name", "def_path").orderBy((F.col("language") != F.col("def_language")).cast("int"), "path", "line")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("key")


def definitions_of(references: DataFrame, definitions: DataFrame, limit: int = 8) -> DataFrame:
    """By call site its definitions elsewhere: language, then kind, path, line."""
    r = references.select(F.lower("name").alias("key"), F.col("name").alias("ref_name"), F.col("language").alias("ref_language"), F.col("path").alias("ref_path"), F.col("line").alias("ref_line"))
    d = definitions.select(F.lower("name").alias("key"), "kind", "language", "path", "line")
    j = r.join(_first(d, limit, kind_order(F.col("kind")), "path", "line"), "key").filter(F.col("path") != F.col("ref_path"))
    w = Window.partitionBy("ref_name", "ref_path", "ref_line").orderBy((F.col("language") != F.col("ref_language")).cast("int"), kind_order(F.col("kind")), "path", "line")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("key")


def in_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """J07, J11.  points: path, line, ...; ranges: path, start_line, end_line, ...: an equi-join on path with the range as residue."""
    return points.join(ranges, "path").filter(F.col("line").between(F.col("start_line"), F.col("end_line")))


#: What each kind of evidence adds.
RELATED_WEIGHTS = {"shared_symbol": 1, "reference": 2, "importer": 10, "imported": 9, "name_import": 3, "shared_import": 2}


def related(signals: DataFrame, limit: int = 20) -> DataFrame:
    """A08, K11.  signals: source_path, path, signal.  Scores add up; the source itself is left out."""
    weights = F.create_map(*[F.lit(x) for kv in RELATED_WEIGHTS.items() for x in kv])
    s = signals.filter(F.col("path") != F.col("source_path")).groupBy("source_path", "path").agg(F.sum(F.try_element_at(weights, F.col("signal"))).alias("score"))
    return ranked(s, F.desc("score"), F.asc("path"), by="source_path").filter(F.col("rank") <= limit)


def test_candidates(path: Column) -> Column:
    """Where tests of a file would be."""
    parts = F.split(path, "/")
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    base = F.element_at(parts, -1)
    stem, ext = F.regexp_replace(base, r"\.[^.]*$", ""), F.regexp_extract(base, r"(\.[^.]*)$", 1)
    at = lambda name: F.array(F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name)), F.concat(F.lit("tests/"), name), F.concat(F.lit("test/"), name))
    return F.array_distinct(F.concat(at(F.concat(F.lit("test_"), stem, ext)), at(F.concat(stem, F.lit("_test"), ext)), at(F.concat(stem, F.lit(".test"), ext)), at(F.concat(stem, F.lit(".spec"), ext))))


def affected(changed: DataFrame, files: DataFrame, related_files: DataFrame, limit: int = 50) -> DataFrame:
    """Of each file the greatest confidence and all reasons: .95 is a test, .85 named after a changed file, .78 related test, .60 related file."""
    own = changed.select("path", F.when(is_test_path(F.col("path")), 0.95).alias("confidence"), F.lit("changed test").alias("reason")).filter("confidence is not null")
    named = changed.select(F.explode(test_candidates(F.col("path"))).alias("path")).join(files.select("path"), "path", "left_semi").select("path", F.lit(0.85).alias("confidence"), F.lit("named after a changed file").alias("reason"))
    r = related_files.join(changed.select(F.col("path").alias("source_path")), "source_path", "left_semi")
    near = r.select("path", F.when(is_test_path(F.col("path")), 0.78).otherwise(0.60).alias("confidence"), F.when(is_test_path(F.col("path")), "related test").otherwise("related file").alias("reason"))
    g = own.unionAll(named).unionAll(near).groupBy("path").agg(F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    return g.orderBy(F.desc("confidence"), "path").limit(limit)


def validation_plan(files: DataFrame, configured: dict[str, str] | None = None) -> DataFrame:
    """K13.  files: path, language.  command, confidence, language: configured ones first, then those of each language."""
    known = {"py": ("python -m pytest", 0.80), "go": ("go test", 0.82), "js": ("npm test --", 0.70), "ts": ("npm test --", 0.70), "rb": ("bundle exec rspec", 0.68)}
    pairs = [x for k, (c, _) in known.items() for x in (F.lit(k), F.lit(c))]
    sure = [x for k, (_, p) in known.items() for x in (F.lit(k), F.lit(p))]
    set_ = [x for k, c in (configured or {}).items() for x in (F.lit(k), F.lit(c))]
    g = files.groupBy("language").agg(F.array_sort(F.collect_set(F.when(is_test_path(F.col("path")), F.col("path")))).alias("tests"))
    own = F.try_element_at(F.create_map(*set_), F.col("language")) if set_ else F.lit(None).cast("string")
    default = F.try_element_at(F.create_map(*pairs), F.col("language"))
    command = F.coalesce(own, F.when(F.size("tests") > 0, F.concat_ws(" ", default, F.array_join("tests", " "))).otherwise(default))
    return g.select("language", command.alias("command"), F.when(own.isNotNull(), 0.92).otherwise(F.try_element_at(F.create_map(*sure), F.col("language"))).alias("confidence")).filter("command is not null").orderBy(F.desc("confidence"), "command")
