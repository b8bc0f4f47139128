"""The corpus memory as a whole: search, contexts, graphs, packs, reports, audit."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code, distance, fixed, text
from ..sources import shared
from ..sources.files import Index
from . import candidates as C
from . import failure, graph, metadata, outside, packs
from . import retrieval as R


@dataclass
class Config:
    """Validation commands by language, ignore patterns."""

    validation: dict[str, str] = field(default_factory=dict)
    ignore: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, content: str) -> Config:
        raw = tomllib.loads(content)
        return cls({text_lang(k): str(v) for k, v in raw.get("validation", {}).items()}, list(raw.get("index", {}).get("ignore", [])))

    STARTER = '[validation]\n# python = "python -m pytest"\n\n[index]\nignore = []\n'


def text_lang(name: str) -> str:
    return fixed.LANGUAGE_ALIASES.get(name.lower(), name.lower())


@dataclass
class Diagnosis:
    """K15.  frames and pack: of a command that failed."""

    ran: outside.Ran
    verdict: str  # passed, failed, stopped (over time), not run (no such command)
    frames: DataFrame | None = None
    pack: DataFrame | None = None


class Memory:
    def __init__(self, index: Index, compressor: distance.Compressor | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None):
        self.index, self.compressor, self.reranker = index, compressor or distance.Zlib(), reranker
        self.spark = index.knowledge.sparkSession

    def _query(self, prompt: str) -> DataFrame:
        return self.spark.createDataFrame([(1, prompt)], "query_id long, text string")

    def corpus(self) -> DataFrame:
        """Chunks with a number of their own, path, topic, text."""
        return self.index.knowledge.select(F.xxhash64("topic").alias("id"), "path", "topic", "language", "start_line", "end_line", F.col("content").alias("text"))

    def search(self, prompt: str, mode: str = "", limit: int = 5) -> DataFrame:
        """Candidates of several query paths and of paths that symbols, references and imports lead to; features, score (lower is better), fusion, protected,
        diverse; then a reranker's order, if there is one."""
        most = packs.limit_of(limit)
        q = self._query(packs.expand_mode(prompt, mode))
        corpus = self.corpus()
        cap = min(max(20 * most, 50), 200)
        found = shared.written(self._hits(q, corpus, cap), "hits")
        structured = shared.written(self._structured(q, cap), "structured-paths")
        places = C.chunks_of_paths(structured, corpus, 2).select("id", "path").join(structured, "path")
        ids = found.select("query_id", "id", "primary_rank", "path_rank").join(places.select("query_id", "id", F.col("rank").alias("structured_rank")), ["query_id", "id"], "full_outer")
        c = shared.written(ids.join(corpus, "id"), "candidates")
        boost = R.lexical_boost(R.token_weights(R.query_tokens(q), c), c)
        bm25 = R.candidate_bm25(q, c)
        exact = metadata.exact_identifiers(q, c)
        tokens = q.select("query_id", F.col("text").alias("q_text"), text.primary_tokens(F.col("text")).alias("q"))
        s = c.join(boost, ["query_id", "id"], "left").join(bm25, ["query_id", "id"], "left").join(exact.withColumnRenamed("boost", "exact"), ["query_id", "id"], "left").join(F.broadcast(tokens), "query_id")
        qnd = distance.qnd(self.compressor)(F.col("q_text"), F.col("text"))
        intent = text.structure_intent(F.col("q_text"))
        structure = F.when((intent != "") & (intent == text.structure_intent(F.col("text"))), 0.10).otherwise(0.0)
        zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
        led = s.withColumn("primary", F.col("primary_rank").isNotNull()).select("query_id", "id", "path", "primary")
        s = s.join(C.structured_boost(led, structured).select("query_id", "id", "structured"), ["query_id", "id"])
        score = qnd - zero("structured") - zero("boost") - zero("bm25") - zero("exact") - text.path_token_boost(F.col("q"), F.col("path")) - structure + text.topic_penalty(F.col("q"), F.col("topic"))
        s = s.withColumn("qnd", qnd).withColumn("score", F.round(score, 9))
        of = lambda column, name: c.filter(F.col(column).isNotNull()).select("query_id", "id", F.col(column).alias(name))
        ranks = {"primary": of("primary_rank", "primary"), "query_path": of("path_rank", "query_path"), "structured": of("structured_rank", "structured"), "bm25": R.value_ranks(bm25, "bm25", "bm25"), "relevance": R.value_ranks(boost, "boost", "relevance")}
        ranks["bm25f"] = self._lexical(q, c, ranks["bm25"])
        fused = R.apply_fusion(s, R.fuse(ranks, fixed.FUSION_WEIGHTS))
        out = R.diversify(fused.withColumn("base", F.col("score")), most)
        out = out.withColumn("rank", F.col("place")).select("query_id", "id", "rank", "path", "topic", "language", "start_line", "end_line", "text", "score", "qnd")
        return self._reranked(out) if self.reranker else out

    def _hits(self, q: DataFrame, corpus: DataFrame, cap: int) -> DataFrame:
        """query_id, id, primary_rank (of the prompt as it is), path_rank (the best of the two other query paths: tokens of the plan, structural tokens)."""
        plan = code.plan(F.col("text"))
        ways = F.array(F.struct(F.lit(0).alias("way"), "text"), F.struct(F.lit(1).alias("way"), F.array_join(plan["fts"], " ").alias("text")), F.struct(F.lit(2).alias("way"), plan["structured"].alias("text")))
        asked = q.select("query_id", F.explode(ways).alias("w")).select(F.struct("query_id", "w.way").alias("query_id"), "w.text")
        top = R.top_k(R.bm25(asked, corpus), cap, F.desc(F.round("score", 9)), F.asc("id")).select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.way").alias("way"), "id", "rank")
        first = top.filter("way = 0").select("query_id", "id", F.col("rank").alias("primary_rank"))
        others = C.best_path_ranks(top.filter("way > 0")).withColumnRenamed("rank", "path_rank")
        return first.join(others, ["query_id", "id"], "full_outer")

    def _structured(self, q: DataFrame, cap: int) -> DataFrame:
        """query_id, path, rank: paths of the symbols, references and imports that answer the prompt."""
        of = lambda rows, columns: metadata.search(rows, q, columns, 10)
        s, r, i = of(self.index.symbols, metadata.SYMBOL_POINTS), of(self.index.references, metadata.REFERENCE_POINTS), of(self.index.imports, metadata.IMPORT_POINTS)
        return C.structured_paths(s.select("query_id", "path", "rank"), r.select("query_id", "path", "rank"), i.select("query_id", "path", "target_path", "rank"), min(cap, 20))

    def _lexical(self, q: DataFrame, c: DataFrame, bm25: DataFrame) -> DataFrame:
        """One rank of the candidates out of Jaccard, BM25 and BM25F by field."""
        fields = {"path": text.tokens(F.col("path")), "topic": text.tokens(F.col("topic")), "content": text.tokens(F.col("text"))}
        weighed = {f: (t, *fixed.BM25F_FIELDS[f]) for f, t in fields.items()}
        by_field = R.value_ranks(R.bm25f(q, c.select("id", "path", "topic", "text"), weighed).withColumn("score", F.round("score", 9)), "score", "bm25f")
        jaccard = R.value_ranks(R.jaccard_scores(q, c.select("id", "text")).withColumn("score", F.round("score", 9)), "score", "jaccard")
        fused = R.fuse({"jaccard": jaccard, "bm25": bm25, "bm25f": by_field}, fixed.LEXICAL_WEIGHTS).withColumn("fusion", F.round("fusion", 9))
        return R.value_ranks(fused, "fusion", "bm25f")

    def _reranked(self, found: DataFrame) -> DataFrame:
        """The reranker returns (id, place); both orders are fused with k = 20, missing places count as n + 1."""
        other = self.reranker(found).select("id", "place").join(found.select("query_id", "id"), "id")
        fused = R.external_fusion(found.select("query_id", "id", "rank"), other).select("query_id", "id", "rank")
        return found.drop("rank").join(fused, ["query_id", "id"])

    def graph_rows(self, seeds: DataFrame, mode: str = "") -> DataFrame:
        """What the graph offers beside the seeds (query_id, id, path, text), a row for each path with its best chunk and place: imports two steps out and in,
        types that the seeds name, and in modes about changes their callers and the definitions of what they call."""
        edges = self.index.imports.filter("target_path <> ''").select(F.col("path").alias("src"), F.col("target_path").alias("dst")).distinct()
        from_ = seeds.select("query_id", F.col("path").alias("seed")).distinct()
        tell = lambda rows, relation, reason, evidence, confidence, line=F.lit(None).cast("int"): rows.select(
            "query_id", "path", line.alias("line"), F.lit(relation).alias("relation"), F.array(F.lit(reason)).alias("reasons"), F.array(evidence).alias("evidence"), F.lit(confidence).cast("double").alias("confidence")
        )
        offered = []
        for relation, e in (("outgoing", edges), ("incoming", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
            near = from_.join(e, F.col("seed") == F.col("src")).select("query_id", "seed", F.col("dst").alias("path"), F.lit(1).alias("depth"))
            far = near.select("query_id", "seed", F.col("path").alias("via")).join(e, F.col("via") == F.col("src")).select("query_id", "seed", F.col("dst").alias("path"), F.lit(2).alias("depth"))
            steps = near.unionAll(far).groupBy("query_id", "seed", "path").agg(F.min("depth").alias("depth")).filter("path <> seed")
            for depth, confidence in ((1, 0.82), (2, 0.70)):
                offered.append(tell(steps.filter(F.col("depth") == depth), relation, "resolved local import graph", F.concat(F.lit("imported by " if relation == "outgoing" else "imports "), "seed"), confidence))
        types = metadata.dependent_types(seeds.select(F.struct("query_id", "id", "path").alias("id"), "text"), self.index.symbols).select("id.query_id", F.col("id.path").alias("seed"), "path", "name").filter("path <> seed")
        offered.append(tell(types, "dependent_type", "type that a hit names", F.concat(F.lit("names "), "name"), 0.84))
        if mode in graph.ROOM and graph.ROOM[mode]:
            s, r = self.index.symbols, self.index.references
            paths = from_.select(F.col("seed").alias("path")).distinct()
            calls = graph.callers(s.join(paths, "path", "left_semi"), r).select(F.col("def_path").alias("seed"), "def_name", "path", "line")
            offered.append(tell(from_.join(calls, "seed"), "symbol_reference", "call of what a hit defines", F.concat(F.lit("calls "), "def_name"), 0.80, F.col("line")))
            named = graph.definitions_of(r.join(paths, "path", "left_semi"), s).select(F.col("ref_path").alias("seed"), "ref_name", "path", "line")
            offered.append(tell(from_.join(named, "seed"), "symbol_definition", "definition of what a hit calls", F.concat(F.lit("defines "), "ref_name"), 0.83, F.col("line")))
        rows = reduce(DataFrame.unionAll, offered)
        merged = graph.merge_candidates(rows, 16)
        at = rows.groupBy("query_id", "path").agg(F.min("line").alias("line"))
        held = F.coalesce(F.col("line").between(F.col("start_line"), F.col("end_line")), F.lit(False))
        spots = merged.join(at, ["query_id", "path"]).withColumnRenamed("rank", "place").join(self.corpus(), "path")
        spots = spots.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "path").orderBy((~held).cast("int"), "start_line", "id"))).filter("nth = 1")
        return spots.select("query_id", "id", "path", "text", "topic", "place", "reasons", "evidence", "confidence")

    def pack(self, prompt: str, mode: str = "", limit: int = 5, budget: int = packs.BUDGET) -> DataFrame:
        """Search, what the graph offers merged in, selection, budget."""
        most = packs.limit_of(limit)
        found = packs.receipts(self.search(prompt, mode, 2 * most).select("query_id", "id", "rank", "path", "topic", "text", "score"), self._query(prompt))
        room = min(graph.ROOM.get(mode, 1), most - 1)
        if room > 0:
            found = shared.written(found, "found")  # read for seeds and for the merge
            found = graph.merge_into(found, self.graph_rows(found.filter("rank <= 3"), mode), 2 * most, room)
        return packs.pack(found, limit, budget, mode)

    def repair_pack(self, output: str, prompt: str = "", limit: int = 5, budget: int = packs.BUDGET) -> DataFrame:
        """Chunks of frames and of named symbols come first, ranked search after."""
        f = self.spark.createDataFrame([(1, output)], "failure_id long, output string")
        frames = failure.frame_rank(failure.frames(f))
        terms = failure.terms(f)
        spots = failure.located(frames, self.index.knowledge).join(frames.select("failure_id", "at", "frame_rank"), ["failure_id", "at"]).select("path", "start_line", F.col("frame_rank").alias("points"))
        named = failure.symbol_rank(terms, self.index.symbols, frames)
        held = graph.in_ranges(named.select("path", "line", "score"), self.index.knowledge.select("path", "start_line", "end_line")).select("path", "start_line", F.col("score").alias("points"))
        best = spots.unionAll(held).groupBy("path", "start_line").agg(F.max("points").alias("points"))
        focus = R.ranked(self.corpus().join(best, ["path", "start_line"]).withColumn("query_id", F.lit(1).cast("long")), F.desc("points"), F.asc("path"), F.asc("id"))
        words = " ".join([prompt, *(terms.head()["terms"] if terms.head() else [])]).strip()
        rest = shared.written(self.search(words or "failure", "debug", max(3 * packs.limit_of(limit), 12)), "ranked")
        place = ["path", "start_line", "end_line"]
        merged = C.merge_snippets(focus.select("query_id", *place, "rank"), rest.select("query_id", *place, "rank"), packs.limit_of(limit))
        r = merged.join(self.corpus(), place).join(rest.select(*place, F.col("score").alias("key")), place, "left")
        rows = packs.receipts(r.withColumn("score", F.when(F.col("focused"), -1.0).otherwise(F.coalesce("key", F.lit(0.0)))).select("query_id", "id", "rank", "path", "topic", "text", "score"), self._query(words))
        return packs.pack(rows, limit, budget, "debug")

    def symbol_context(self, prompt: str, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """Definitions and references."""
        q = self._query(prompt)
        return metadata.search(self.index.symbols, q, metadata.SYMBOL_POINTS, limit), metadata.search(self.index.references, q, metadata.REFERENCE_POINTS, limit)

    def import_context(self, prompt: str, limit: int = 20) -> DataFrame:
        return metadata.search(self.index.imports, self._query(prompt), metadata.IMPORT_POINTS, limit)

    def cards(self, prompt: str, limit: int = 20) -> DataFrame:
        return metadata.search_cards(self.index.cards, self._query(prompt), limit)

    def dependency_graph(self, path: str) -> dict[str, DataFrame]:
        """The six lists of a file."""
        i, s, r = self.index.imports, self.index.symbols, self.index.references
        own, calls = s.filter(F.col("path") == path), r.filter(F.col("path") == path)
        return {"imports": i.filter(F.col("path") == path), "imported_by": i.filter(F.col("target_path") == path), "symbols": own, "references": calls, "referenced_by": graph.callers(own, r), "reference_definitions": graph.definitions_of(calls, s)}

    def related_signals(self) -> DataFrame:
        """Evidence that two files belong together."""
        i, s, r = self.index.imports.filter("target_path <> ''"), self.index.symbols, self.index.references
        out = i.select(F.col("path").alias("source_path"), F.col("target_path").alias("path"), F.lit("imported").alias("signal"))
        back = i.select(F.col("target_path").alias("source_path"), "path", F.lit("importer").alias("signal"))
        used = r.select("name", F.col("path").alias("source_path")).join(s.select("name", "path"), "name").select("source_path", "path", F.lit("reference").alias("signal"))
        return out.unionAll(back).unionAll(used)

    def related(self, path: str, limit: int = 20) -> DataFrame:
        return graph.related(self.related_signals().filter(F.col("source_path") == path), limit)

    def affected(self, paths: list[str], limit: int = 50) -> DataFrame:
        c = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return graph.affected(c, self.index.files.select("path"), graph.related(self.related_signals()), limit)

    def validation(self, paths: list[str], config: Config | None = None) -> DataFrame:
        """Command, confidence: configured commands come before those that languages have; each once."""
        a = self.affected(paths).select("path").union(self.spark.createDataFrame([(p,) for p in paths], "path string")).distinct()
        set_ = (config or Config()).validation
        plan = graph.validation_plan(a.withColumn("language", text.path_language(F.col("path"))), set_)
        own = F.col("language").isin(list(set_)) if set_ else F.lit(False)
        return graph.merge_commands([plan.filter(own), plan.filter(~own)]).orderBy("group_no", F.desc("confidence"), "command").select("command", "confidence")

    def diagnose(self, command: str, folder: str | None = None, seconds: float = 600, prompt: str = "", limit: int = 5, budget: int = packs.BUDGET) -> Diagnosis:
        """The command is run; where it fails, what it said is read for frames and names, and a repair pack is made of them."""
        ran = outside.run(command, folder, seconds)
        if ran.passed:
            return Diagnosis(ran, "passed")
        said = self.spark.createDataFrame([(1, ran.output)], "failure_id long, output string")
        frames = failure.frame_rank(failure.frames(said)).select("at", "path", "line_no", "function", "frame_rank")
        verdict = "stopped" if ran.code == outside.STOPPED else "not run" if ran.code == outside.ABSENT else "failed"
        return Diagnosis(ran, verdict, frames, self.repair_pack(ran.output, prompt, limit, budget) if verdict == "failed" else None)

    def validate(self, paths: list[str], config: Config | None = None, folder: str | None = None, seconds: float = 600) -> list[Diagnosis]:
        """The plan's commands in their order, up to the first that fails."""
        out = []
        for r in self.validation(paths, config).limit(outside.MOST_ROWS).collect():
            out.append(self.diagnose(r["command"], folder, seconds))
            if out[-1].verdict != "passed":
                break
        return out

    def report(self, paths: list[str], limit: int = 5) -> dict[str, DataFrame]:
        """What a change touches, how to check it, what to read."""
        return {"affected": self.affected(paths), "validation": self.validation(paths), "pack": self.pack("review changes to " + " ".join(paths), "review", limit)}

    def repo_map(self, limit: int = 20) -> DataFrame:
        """A16."""
        s = self.index.symbols
        top = s.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(packs.limit_of(limit, 20))
        return R.top_k(s.join(top, "path"), 25, F.asc("line"), F.asc("name"), by="path").groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))).alias("symbols"))

    def stats(self) -> DataFrame:
        return self.index.stats()

    def audit(self, config: Config | None = None) -> DataFrame:
        """Check, status, detail."""
        secrets = self.index.knowledge.filter(F.col("content").rlike(fixed.SECRET_ASSIGNMENT)).agg(F.count("*").alias("n"), F.min("path").alias("path"))
        checked = secrets.select(F.lit("secrets").alias("check"), F.when(F.col("n") == 0, "pass").otherwise("fail").alias("status"), F.coalesce("path", F.lit("")).alias("detail"))
        size = self.index.knowledge.agg(F.count("*").alias("n")).select(F.lit("index").alias("check"), F.when(F.col("n") > 0, "pass").otherwise("warn").alias("status"), F.col("n").cast("string").alias("detail"))
        ignore = self.spark.createDataFrame([("ignore", "pass" if config and config.ignore else "warn", ",".join(config.ignore) if config else "")], "check string, status string, detail string")
        return checked.unionByName(size).unionByName(ignore)
